"""A trie of conversation prefixes: balanced parentheses a shard, with spines that shards share merged in tiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import exchange_width, salted_join, text_of, write_once

#: Bytes of a turn in a path: a digest of its role and text, and the code points of the text.
TURN = 20
#: Nodes of one shard's trie, and parentheses of one block of excess.
SHARD_NODES, EXCESS_BLOCK = 20_000, 64
#: Text of member ids that is hashed or moved at once.
CHUNK_BYTES = 1 << 16
SHARED_TURNS, DONOR_STEP, SHARE_MOD = 5, 100, 6

_NODE = np.dtype([("n", "<i8"), ("least", "<i8"), ("saved", "<i8"), ("leaves", "<i8"), ("children", "<i8"), ("ends", "V32")])
_NO_ENDS = b"\0" * 32
_MOST = np.iinfo(np.int64).max

_ROWS = "key binary, start int, vals binary"
_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, node binary, parent binary, key binary, start int, vals binary"
_KINDS = (pa.int64(),) * 7 + (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


class Parentheses:
    """A forest's shape in preorder, an opening bit a node, with the least and greatest excess of each block and of runs of blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        n = -(-len(bits) // EXCESS_BLOCK)
        padded = np.full(n * EXCESS_BLOCK, self.excess[-1] if len(bits) else 0)
        padded[: len(bits)] = self.excess
        blocks = padded.reshape(n, EXCESS_BLOCK)
        self.least, self.most = [blocks.min(axis=1)], [blocks.max(axis=1)]
        while len(self.least[-1]) > 1:  # each level halves the one below
            for levels, least in ((self.least, True), (self.most, False)):
                low = levels[-1]
                even = np.append(low, low[-1:]) if len(low) % 2 else low
                levels.append((np.minimum if least else np.maximum)(even[::2], even[1::2]))
        leaf = np.zeros(len(bits), np.int64)
        leaf[:-1] = bits[:-1] & ~bits[1:]
        self.leaf_rank = np.concatenate(([0], np.cumsum(leaf)))

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening one: the first place after it whose excess is one less than at it."""
        target = self.excess[opens] - 1
        found = np.full(len(opens), -1, np.int64)
        going, at = np.arange(len(opens)), opens + 1
        ends = np.minimum((opens // EXCESS_BLOCK + 1) * EXCESS_BLOCK, len(self.bits))
        self._scan(going, at, ends, target, found)
        going = np.flatnonzero(found < 0)
        node, level = opens[going] // EXCESS_BLOCK, 0
        block = np.full(len(going), -1, np.int64)
        climbing = np.arange(len(going))
        stops: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(climbing):  # up, until a run of blocks to the right holds the target
            here = node[climbing]
            right = np.where(here % 2 == 0, here + 1, -1)
            ok = (right >= 0) & (right < len(self.least[level]))
            safe = np.where(ok, right, 0)
            hit = ok & (self.least[level][safe] <= target[going[climbing]]) & (target[going[climbing]] <= self.most[level][safe])
            stops.append((level, climbing[hit], right[hit]))
            climbing = climbing[~hit]
            node[climbing] //= 2
            level += 1
        for level, who, run in stops:  # and down again to the first block of that run
            for below in range(level - 1, -1, -1):
                left = 2 * run
                run = np.where(self.least[below][left] <= target[going[who]], left, left + 1)
            block[who] = run
        self._scan(going, block * EXCESS_BLOCK, np.minimum((block + 1) * EXCESS_BLOCK, len(self.bits)), target, found)
        return found

    def _scan(self, going: np.ndarray, at: np.ndarray, ends: np.ndarray, target: np.ndarray, found: np.ndarray) -> None:
        at = at.copy()
        open_ = np.flatnonzero(at < ends)
        while len(open_):
            hit = self.excess[at[open_]] == target[going[open_]]
            found[going[open_[hit]]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < ends[open_]]


def _common_turns(turns: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each path, how many turns it shares with the one before."""
    n = len(sizes)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    most = np.minimum(sizes[1:], sizes[:-1])
    place = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
    differ = (turns[np.repeat(first[1:], most) + place] != turns[np.repeat(first[:-1], most) + place]).any(axis=1)
    place[~differ] = _MOST
    some = most > 0
    if some.any():
        least = np.minimum.reduceat(place, (np.cumsum(most) - most)[some])
        shared[1:][some] = np.minimum(least, most[some])
    return shared


def _range_least(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of ``size`` values from ``first`` on."""
    table = [values]
    while 2 * (1 << (len(table) - 1)) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    out = np.empty(len(first), np.int64)
    power = np.frexp(size.astype(float))[1] - 1
    for k in np.unique(power).tolist():
        mine = power == k
        out[mine] = np.minimum(table[k][first[mine]], table[k][first[mine] + size[mine] - (1 << k)])
    return out


def _path_names(key: bytes) -> list[bytes]:
    """A digest of each prefix of a path, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for at in range(0, len(key), TURN):
        state.update(key[at : at + TURN])
        out.append(state.digest())
    return out


def _shard(keys: list[bytes], starts: list[int], vals: list[bytes], later: bool, final: bool) -> Iterator[pa.RecordBatch]:
    """One trie over sorted paths. A path tells of its nodes from depth ``start`` on what is known of them apart from the trie.

    Nodes on the first and the last path may stand in other shards too; unless this is the last tier they go on as paths, less
    what their own open child carries. All others are finished. Finished nodes of a ``later`` tier were such spines before: nodes
    of earlier tiers know them by the digest of their path.
    """
    sizes = np.array([len(k) // TURN for k in keys], np.int64)
    first = np.cumsum(sizes) - sizes
    turns = np.frombuffer(b"".join(keys), ">u4").reshape(-1, TURN // 4)
    shared = _common_turns(turns, first, sizes)
    fresh = sizes - shared
    n = 1 + int(fresh.sum())
    base = 1 + np.cumsum(fresh) - fresh
    depth, parent, points = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    owner = np.repeat(np.arange(len(keys)), fresh)
    depth[1:] = np.arange(n - 1) - np.repeat(base - 1, fresh) + np.repeat(shared, fresh) + 1
    points[1:] = turns[first[owner] + depth[1:] - 1, TURN // 4 - 1]
    parent[1:] = np.arange(n - 1)
    own = np.zeros(n, _NODE)
    own["least"] = _MOST
    path = np.zeros(int(sizes.max(initial=0)) + 1, np.int64)
    left = right = None
    names: dict[int, bytes] = {0: _path_names(b"")[0]} if later else {}
    for j, (a, size, k) in enumerate(zip(shared.tolist(), sizes.tolist(), base.tolist())):
        if size > a:
            parent[k] = path[a]
            path[a + 1 : size + 1] = np.arange(k, k + size - a)
            if later:
                names |= zip(range(k, k + size - a), _path_names(keys[j])[a + 1 :])
        at, told = path[starts[j] : size + 1], np.frombuffer(vals[j], _NODE)
        for c in ("n", "saved", "leaves", "children"):
            own[c][at] += told[c]
        own["least"][at] = np.minimum(own["least"][at], told["least"])
        named = told["ends"] != np.void(_NO_ENDS)
        own["ends"][at[named]] = told["ends"][named]
        if j == 0:
            left = path[: size + 1].copy()
    right = path[: int(sizes[-1]) + 1].copy()

    # preorder with its closings: before each new branch, what stands deeper than its parent closes
    closing = np.concatenate((np.maximum(depth[:-1] - depth[1:] + 1, 0), [depth[-1] + 1]))
    opens = np.arange(n) + np.cumsum(closing) - closing
    bits = np.zeros(2 * n, bool)
    bits[opens] = True
    tree = Parentheses(bits)
    closes = tree.findclose(opens)
    count = (closes - opens + 1) // 2
    nodes = np.arange(n)
    below = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[nodes + count] - c[nodes]
    n_convs = below(own["n"])
    least = _range_least(own["least"], nodes, count)
    local = np.bincount(parent[1:], minlength=n)
    children = local + own["children"]
    # leaf pairs of the subtree, less those whose children stand in other shards, and the leaves that paths brought along
    apart = (local == 0) & (own["children"] > 0)
    leaves = tree.leaf_rank[closes] - tree.leaf_rank[opens] - below(apart) + below(own["leaves"])
    worth = (n_convs - 1) * points
    saved = below(worth) + below(own["saved"])
    open_ = np.zeros(n, bool)
    if not final:
        open_[left] = open_[right] = True
    spines = {int(v): x for row, spine in ((0, left), (-1, right)) for v, x in zip(spine, _path_names(keys[row]))} if not final else {}
    done = np.flatnonzero(~open_)
    up = parent[done]
    known = (up >= 0) & ~open_[np.maximum(up, 0)]
    ends = own["ends"][done].tobytes()
    columns = [
        least[done].tolist(),
        depth[done].tolist(),
        [v if k else None for v, k in zip(least[np.maximum(up, 0)].tolist(), known.tolist())],
        n_convs[done].tolist(),
        children[done].tolist(),
        leaves[done].tolist(),
        saved[done].tolist(),
        [ends[32 * k : 32 * k + 32] for k in range(len(done))],
        [names.get(v) for v in done.tolist()],
        [spines.get(u) for u in up.tolist()],
    ]
    for a in range(0, len(done), 20_000):
        part = [pa.array(c[a : a + 20_000], t) for c, t in zip(columns, _KINDS)]
        yield pa.RecordBatch.from_arrays(part + [pa.nulls(len(part[0]), t) for t in _KINDS[10:]], names=_NAMES)
    if final:
        return
    inner = np.flatnonzero(open_ & (parent >= 0))
    less = {c: np.zeros(n, np.int64) for c in ("n", "saved", "leaves", "children")}
    for c, x in (("n", n_convs), ("saved", saved), ("leaves", leaves), ("children", np.ones(n, np.int64))):
        np.add.at(less[c], parent[inner], x[inner])
    on = np.zeros(n, _NODE)
    on["n"], on["least"], on["ends"] = n_convs - less["n"], least, own["ends"]
    on["saved"] = saved - worth - less["saved"]
    on["leaves"] = leaves - less["leaves"] - ((local == 0) & (own["children"] == 0))
    on["children"] = children - less["children"]
    both = int(np.argmin(np.append(left[: len(right)] == right[: len(left)], False)))
    rows = [(keys[0], 0, on[left].tobytes())]
    if both < len(right):
        rows.append((keys[-1], both, on[right[both:]].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for t in _KINDS[:10]] + [pa.array(c, t) for c, t in zip(zip(*rows), _KINDS[10:])], names=_NAMES)


def _shards(later: bool, final: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        starts: list[int] = []
        vals: list[bytes] = []
        size = 0
        for batch in batches:
            for key, start, told in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not final and size > most and len(keys) >= 16:
                    yield from _shard(keys, starts, vals, later, final)
                    keys, starts, vals, size = [], [], [], 0
                keys.append(key)
                starts.append(start)
                vals.append(told)
                size += len(key) // TURN
        if keys:
            yield from _shard(keys, starts, vals, later, final)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to runs of one key: (key, first id, number of ids, ids as text)."""
    rows: list[tuple] = []
    now: list = []
    size = total = 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "least", "n", "ids"])

    for b in batches:
        for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if now and (now[0] != key or size >= CHUNK_BYTES):
                rows.append((now[0], now[1][0], len(now[1]), ",".join(map(str, now[1]))))
                total += size + len(now[0])
                now, size = [], 0
                if total >= 4 << 20:
                    yield batch()
                    rows, total = [], 0
            if not now:
                now = [key, []]
            now[1].append(conv)
            size += 12
    if now:
        rows.append((now[0], now[1][0], len(now[1]), ",".join(map(str, now[1]))))
    yield batch()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by key and first id to paths that tell of their last node: members, least member and digest of all ids."""
    key, state, n, least = None, None, 0, 0

    def told() -> tuple:
        node = np.zeros(1, _NODE)
        node["n"], node["least"], node["ends"] = n, least, np.void(state.digest())
        return key, len(key) // TURN, node.tobytes()

    for batch in batches:
        rows = []
        for k, first, count, ids in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    rows.append(told())
                key, state, n, least = k, hashlib.sha256(), 0, first
            state.update(ids.encode())
            n += count
        yield _paths_batch(rows)
    if key is not None:
        yield _paths_batch([told()])


def _paths_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary()))], names=["key", "start", "vals"])


def rebuilt(conversations: DataFrame, shared: Column | None = None) -> DataFrame:
    """(conv_id, key): each conversation's path, its first turns taken from the conversation that it shares a prefix with.

    ``shared`` is how many turns come from there (a CRC-32 of the id by default, at most ``SHARED_TURNS``).
    """
    role, text = text_of("role"), text_of("text")
    turn = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.length(text)), 8, "0"))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn.alias("x")).alias("t"))
    whole = write_once(slim.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]).alias("own")), "trie-turns")
    count = shared if shared is not None else (F.crc32(F.col("conv_id").cast("string")) % SHARE_MOD).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % DONOR_STEP
    donors = whole.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("own", 1, SHARED_TURNS).alias("lead"))
    joined = whole.select("conv_id", "own", base.alias("base"), count.alias("h")).join(donors, "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(lead, rest), "")).alias("key"))


def prefix_trie(conversations: DataFrame, parts: int | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is a path of turns, 20 bytes each. Equal paths become one first; their members' ids are hashed in order from
    runs of ids, so a conversation that many share costs its last task the text of the ids and no row an id. Paths are dealt
    by ranges; each task cuts its range into shards of about ``shard_nodes`` nodes, encodes a shard as balanced parentheses and
    reads subtrees off it: findclose gives their bounds, ranks of leaf pairs their leaves, running totals their savings. Nodes on
    a shard's first and last path may stand in its neighbours too; these spines, a path or two a shard, are the paths of the
    next tier, until one shard is left.

    Turns are in ascending order, null first; turns of one number by a digest of role and text. A null role or text counts as
    an empty one. A row without a conv_id belongs to no conversation. Repeated rows are repeated turns. Turns are told apart by
    MD5. An empty table has no node. Other columns are not read. One conversation's turns meet in a task, 60 bytes each.
    """
    spark = conversations.sparkSession
    width = exchange_width(spark, parts)
    members = write_once(rebuilt(conversations), "trie-members").select("key", "conv_id")
    runs = map_arrow(members.repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id"), _members, "key binary, least long, n long, ids string")
    ends = map_arrow(runs.repartition(width, "key").sortWithinPartitions("key", "least"), _ends, _ROWS)
    paths = write_once(ends, "trie-paths")
    finished = None
    while True:
        total = paths.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("key") / TURN), F.lit(0)).alias("turns")).first()
        final = total["turns"] <= shard_nodes or total["rows"] <= 32
        shards = 1 if final else max(2, min(width, int(total["turns"] // shard_nodes) + 1, total["rows"] // 16)) if finished is not None else min(width, max(2, total["rows"] // 16))
        dealt = (paths.repartition(1) if final else paths.repartitionByRange(shards, "key")).sortWithinPartitions("key", "start")
        found = write_once(map_arrow(dealt, _shards(finished is not None, final, shard_nodes), _OUT), "trie-nodes")
        nodes = found.where("vals is null")
        finished = nodes if finished is None else finished.unionByName(nodes)
        if final:
            break
        paths = found.where("vals is not null").select("key", "start", "vals")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    spines = finished.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("__of"))
    late = salted_join(finished.where("parent is not null").select(*columns, "parent"), spines, "parent", "conv_id").withColumn("parent_conv_id", F.col("__of")).select(*columns)
    whole = finished.where("parent is null").select(*columns).unionByName(late)
    none = F.col("ends") == F.lit(_NO_ENDS)
    return whole.withColumn("ends_sha256", F.when(none, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("ends")))).drop("ends")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same nodes from (conv_id, turn, role, text) by dictionaries of whole prefixes, for tests on small tables."""
    import zlib

    def order(r: tuple) -> tuple:
        role, text = r[2] or "", r[3] or ""
        return r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + f"{len(text):08x}"

    own: dict[int, list] = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % SHARE_MOD
        base = c - (abs(c) % DONOR_STEP) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    convs: dict[tuple, list] = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            convs.setdefault(path[:d], []).append(c)
    below: dict[tuple, list] = {p: [] for p in convs}
    for p in convs:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, ids in convs.items():
        children = [q for q in below[p] if len(q) == len(p) + 1]
        leaf = [q for q in below[p] if len(below[q]) == 1]
        saved = sum((len(convs[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        ended = ",".join(str(c) for c in sorted(c for c in ids if paths[c] == p))
        out.append((min(ids), len(p), min(convs[p[:-1]]) if p else None, len(ids), len(children), len(leaf), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return out


SQL = """
with recursive o as (select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first) as own from conversations where conv_id is not null group by conv_id),
h as (select conv_id, own, conv_id - conv_id % 100 as base, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)), 4294967295::bigint) % 6)::int as h from o),
p as (select h.conv_id, list_concat(coalesce(d.own, [])[1:h.h], h.own[h.h + 1:]) as path from h left join o d on d.conv_id = h.base),
x as (select conv_id, len(path) as n, d::bigint as depth, sha256(path[1:d]::varchar) as node, case when d > 0 then sha256(path[1:d - 1]::varchar) end as parent, case when d > 0 then length(path[d].t) else 0 end as points from (select *, unnest(range(0, len(path) + 1)) as d from p)),
nd as (select node, depth, parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(points) as worth, sha256(coalesce(string_agg(case when n = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from x group by node, depth, parent),
ch as (select parent as node, count(*) as n_children from nd where parent is not null group by parent),
w as (select nd.*, coalesce(n_children, 0) as n_children from nd left join ch using (node)),
up(node, above, worth, leaf) as (select node, parent, worth, (n_children = 0)::int from w union all select up.node, w.parent, up.worth, up.leaf from up join w on w.node = up.above),
su as (select above as node, sum(worth) as worth, sum(leaf) as leaf from up where above is not null group by above)
select w.conv_id, w.depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, (coalesce(su.leaf, 0) + (w.n_children = 0)::int)::bigint as n_leaves, (coalesce(su.worth, 0) + w.worth)::bigint as saved_tokens, w.ends_sha256
from w left join su using (node) left join w q on q.node = w.parent
"""
