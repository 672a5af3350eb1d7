"""Queries on ingest: release lines, quarantine, records, sinks and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entities import decode_entities, entities_sql
from ..functions.evidence import ascii_upper, sequence_digest
from ..operators import hooks
from ..operators.ranks import evenly_spaced
from ..operators.snapshots import set_digest
from ..similarity.common import write_once
from ..sources import releases as rel
from ..sources.tables import OBS, observations, table
from ..streaming import arrivals
from .registry import query
from .snapshot_plans import DIFF, SLOT, digest_sql, rows_of

HEADER = ["item", "grp", "assay", "relation", "value", "note"]
GOOD = OBS + """, ordered as (select okey, line, item, grp, assay, rel, v, src, pub, row_number() over (order by okey, line, item, assay, v) + 1 as line_no from obs),
fields as (select line_no, item::varchar as f1, grp::varchar as f2, case when okey % 9 = 0 then '' else assay::varchar end as f3, rel as f4, floor(v)::bigint::varchar as f5, case okey % 4 when 0 then '' when 1 then '  ' else src end as f6, okey % 101 = 0 or okey % 103 = 0 as bad from ordered)"""
ORDER = ["okey", "line", "item", "assay", "v"]


def release_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as raw lines of a release: some with a field too many, some that are no UTF-8."""
    obs = observations(spark, sf_dir).select(*ORDER, "grp", "rel", "src")
    note = F.when(F.col("okey") % 4 == 0, "").when(F.col("okey") % 4 == 1, "  ").otherwise(F.col("src"))
    assay = F.when(F.col("okey") % 9 == 0, "").otherwise(F.col("assay").cast("string"))
    line = F.concat_ws("\t", F.col("item").cast("string"), F.col("grp").cast("string"), assay, "rel", F.floor("v").cast("string"), note)
    raw = F.encode(F.when(F.col("okey") % 101 == 0, F.concat(line, F.lit("\textra"))).otherwise(line), "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("FFFE")))
    return obs.select(*ORDER, F.when(F.col("okey") % 103 == 0, broken).otherwise(raw).alias("raw"))


def read_back(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame]:
    """The release as files, read again: its header and its numbered lines. All loading starts from here."""
    path = rel.scratch(spark, "release")
    rel.write_release(release_lines(spark, sf_dir), HEADER, path, ORDER)
    return rel.read_release(spark, path, ["item", "grp", "value"])


def loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows and quarantine of the release."""
    header, lines = read_back(spark, sf_dir)
    good, bad = rel.split_lines(lines, len(header))
    return rel.to_payload(good, header), bad


@query("SRC01", f"with {GOOD} select count(*) as n_lines, sum(length(f1 || f2 || f3 || f4 || f5 || f6) + 5 + case when okey % 101 = 0 then 6 else 0 end + case when okey % 103 = 0 then 2 else 0 end)::bigint as n_bytes, count(*) filter (where okey % 103 = 0) as n_not_utf8 from fields join (select line_no, okey from ordered) using (line_no)")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release is written as text and read again as bytes, split at line feeds only."""
    _, lines = read_back(spark, sf_dir)
    broken = F.try_validate_utf8(F.col("raw").cast("string")).isNull()
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("raw")).alias("n_bytes"), F.count_if(broken).alias("n_not_utf8"))


@query("SRC02", f"with {GOOD}, p as (select unnest(['item', 'grp', 'assay', 'relation', 'value', 'note']) as column_name, unnest(range(0, 6))::int as position, unnest([f1, f2, f3, f4, f5, f6]) as value from fields where not bad) select column_name, position, count(*) filter (where value <> '') as n_present from p group by all")
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header is read from the release, decoded and checked; its columns are then counted over the lines that have its width."""
    header, lines = read_back(spark, sf_dir)
    good, _ = rel.split_lines(lines, len(header))
    counts = good.select(F.split("text", "\t", -1).alias("f")).agg(F.array(*[F.count_if(F.col("f")[k] != "") for k in range(len(header))]).alias("n"))
    named = F.arrays_zip(F.array(*map(F.lit, header)).alias("c"), F.col("n").alias("n"))
    return counts.select(F.posexplode(named).alias("position", "x")).select(F.col("x.c").alias("column_name"), "position", F.col("x.n").alias("n_present"))


@query("SRC03", f"with {GOOD} select line_no, (f1 <> '')::int + (f2 <> '')::int + (f3 <> '')::int + (f4 <> '')::int + (f5 <> '')::int + (f6 <> '')::int as n_fields, nullif(f3, '') as assay, nullif(f6, '') as note from fields where not bad")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = loaded(spark, sf_dir)
    return rows.select("line_no", F.size("payload").alias("n_fields"), F.col("payload")["assay"].alias("assay"), F.col("payload")["note"].alias("note"))


@query("SRC04", f"with {GOOD}, o as (select line_no, okey from ordered) select line_no, case when okey % 103 = 0 then 'invalid_utf8' else 'field_count' end as rule, (length(f1 || f2 || f3 || f4 || f5 || f6) + 5 + case when okey % 101 = 0 then 6 else 0 end + case when okey % 103 = 0 then 2 else 0 end)::bigint as byte_length from fields join o using (line_no) where bad")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = loaded(spark, sf_dir)
    return bad.select("line_no", "rule", "byte_length")


@query("SRC05", f"with {GOOD} select f.line_no, f1 as item, f4 as relation, (length(f1 || f2 || f3 || f4 || f5 || f6) + 5 + case when okey % 101 = 0 then 6 else 0 end + case when okey % 103 = 0 then 2 else 0 end)::bigint as byte_length from fields f join (select line_no, okey from ordered) o using (line_no)")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were read with their numbers, whether they can be loaded or not."""
    _, lines = read_back(spark, sf_dir)
    field = lambda k: F.split_part(F.make_valid_utf8(F.col("raw").cast("string")), F.lit("\t"), F.lit(k))
    return lines.select("line_no", field(1).alias("item"), field(4).alias("relation"), F.octet_length("raw").cast("long").alias("byte_length"))


@query("SRC06", f"with {GOOD}, o as (select line_no, okey from ordered) select count(*) as n_lines, count(*) filter (where not bad) as n_loaded, count(*) filter (where bad) as n_excluded, count(*) filter (where okey % 103 = 0) as n_invalid_utf8, count(*) filter (where okey % 101 = 0 and okey % 103 <> 0) as n_field_count, round(avg((f1 <> '')::int + (f2 <> '')::int + (f3 <> '')::int + (f4 <> '')::int + (f5 <> '')::int + (f6 <> '')::int) filter (where not bad), 6) as mean_fields, true as reconciles from fields join o using (line_no)")
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, lines = read_back(spark, sf_dir)
    return rel.reconciliation(lines, header).withColumn("mean_fields", F.round("mean_fields", 6))


@query("SRC07", f"with {GOOD} select line_no, concat_ws(chr(9), f1, f2, f3, f4, f5, f6) as text from fields where not bad")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = loaded(spark, sf_dir)
    return rows.select("line_no", rel.reconstruct(F.col("payload"), HEADER).alias("text"))


@query(
    "SRC08",
    """with r as (select strftime(o_orderdate, '%Y-%m') as release, md5(strftime(o_orderdate, '%Y-%m') || ':' || count(*) || ':' || sum(o_orderkey)::bigint) as digest, count(*) % 4 as k from orders group by strftime(o_orderdate, '%Y-%m'))
  select release, digest, case k when 0 then 'absent' when 1 then 'conflict' when 2 then 'ingested' else 'unparsed' end as state from r""",
)
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release a month of orders arrives at a machine that has seen some of them, finished or not, or with another digest."""
    content = F.concat_ws(":", F.col("release"), F.count("*").cast("string"), F.sum("o_orderkey").cast("string"))
    incoming = write_once(table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("release")).agg(F.md5(content).alias("digest"), (F.count("*") % 4).alias("k")), "incoming")
    digest = F.when(F.col("k") == 1, "other").otherwise(F.col("digest"))
    word = lambda rows, digest, event, day: rows.select("release", digest.alias("digest"), F.lit(event).alias("event"), F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("at"))
    seen = word(incoming.where("k <> 0"), digest, "arrived", 1).unionByName(word(incoming.where("k = 2"), digest, "finished", 1))
    folder = rel.scratch(spark, "machine")
    for events in (seen, word(incoming, F.col("digest"), "arrived", 2)):
        events.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        answers = arrivals.run_release_machine(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", patience="30 days")
    return answers.where(F.col("at") == F.lit("2024-01-02 00:00:00").cast("timestamp")).select("release", "digest", "state")


@query("SRC09", "select s_suppkey as line_no0, s_name as name, s_nationkey::varchar as nation from supplier")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side table by the same steps: write as tab-separated text, read, split, check, map."""
    path = rel.scratch(spark, "side")
    table(spark, sf_dir, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string")).alias("value")).write.text(path)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("line_no"), F.encode("value", "UTF-8").alias("raw"))
    good, _ = rel.split_lines(lines, 3)
    payload = F.col("payload")
    return rel.to_payload(good, ["key", "name", "nation"]).select(payload["key"].cast("long").alias("line_no0"), payload["name"].alias("name"), payload["nation"].alias("nation"))


RECORD_LINES = """bl as (select conv_id, role, turn, case when turn % 7 = 3 then '' else translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz>', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-') end as body from conversations),
rl as (select conv_id as file, turn::bigint * 1000000 as line_no, '>' || role || ' ' || turn as text from bl
  union all select conv_id, turn::bigint * 1000000 + 1 + k, substr(body, 60 * k + 1, 60) from (select *, unnest(range(0, greatest(1, (length(body) + 59) // 60))) as k from bl))"""


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a record: a header line, and its whole text in lines of 60 characters."""
    text = F.replace(ascii_upper(F.coalesce("text", F.lit(""))), F.lit(">"), F.lit("-"))
    c = table(spark, sf_dir, "conversations").withColumn("body", F.when(F.col("turn") % 7 == 3, "").otherwise(text))
    base = F.col("turn").cast("long") * 1_000_000
    head = c.select(F.col("conv_id").alias("file"), base.alias("line_no"), F.concat(F.lit(">"), "role", F.lit(" "), F.col("turn").cast("string")).alias("text"))
    lines = c.select("conv_id", "turn", "body", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("body") - 1) / 60).cast("int")))).alias("k"))
    return head.unionByName(lines.select(F.col("conv_id").alias("file"), (base + 1 + F.col("k")).alias("line_no"), F.substr("body", 60 * F.col("k") + 1, F.lit(60)).alias("text")))


@query(
    "SRC10",
    f"""with {RECORD_LINES}, r as (select file, line_no, text, sum((text like '>%')::int) over (partition by file order by line_no rows unbounded preceding) as ordinal from rl)
  select file, ordinal::bigint as ordinal, max(substr(text, 2)) filter (where text like '>%') as description, string_agg(text, '' order by line_no) filter (where text not like '>%') as sequence from r group by file, ordinal having coalesce(string_agg(text, '') filter (where text not like '>%'), '') <> ''""",
)
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rel.fasta_records(record_lines(spark, sf_dir))
    return good.select("file", "ordinal", "description", "sequence")


@query(
    "SRC12",
    f"""with {RECORD_LINES}, f as (select file, count(*) as n_lines, count(*) filter (where text like '>%') as n_records, list(text order by line_no) as content from rl group by file), h as (select *, list_filter(content, lambda x: x like '>%') as heads from f)
  select file, n_lines, n_records, heads[1] as first_header, array_to_string(heads[1:3], '|') as sample, sha256(array_to_string(content, chr(10))) as digest, file % 3 = 0 as pin_matches from h""",
)
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files inspected against pins: a third are pinned as they are, a third otherwise, a third not."""
    lines = record_lines(spark, sf_dir)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text), "\n")
    pins = lines.where("file % 3 <> 2").groupBy("file").agg(F.when(F.col("file") % 3 == 0, F.sha2(content, 256)).otherwise("other").alias("pin"))
    return rel.inspect_files(lines, pins)


@query(
    "SRC13",
    f"""with {OBS} select count(*) as n_rows, count(*) filter (where rel = '=') as n_exact, count(pub) as n_with_pub, count(distinct pub) as n_pubs, count(*) as n_with_locator, sum(okey)::bigint as sum_keys, true as in_order from obs""",
)
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations exported with their provenance as compressed JSON lines in a stable order, counted while they are written, and read again."""
    order = ["okey", "line", "item", "assay", "v"]
    path = rel.scratch(spark, "export")
    seen = Observation("export")
    counters = [F.count("*").alias("n_rows"), F.count_if(F.col("rel") == "=").alias("n_exact"), F.count("pub").alias("n_with_pub"), F.count_if(F.col("okey").isNotNull() & F.col("line").isNotNull()).alias("n_with_locator")]
    ordered = observations(spark, sf_dir).select(*order, "grp", "mtype", "rel", "pub", "src").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.observe(seen, *counters).write.json(path, compression="gzip")
    counts = seen.get
    back = spark.read.schema("okey long, line int, pub string").json(path).select("okey", "line", "pub", F.input_file_name().alias("file"))
    files = back.groupBy("file").agg(F.min(F.struct("okey", "line")).alias("least"), F.max(F.struct("okey", "line")).alias("most"))
    turns = files.withColumn("before", F.lag("most").over(Window.orderBy("file"))).agg(F.bool_and(F.coalesce(F.col("before") <= F.col("least"), F.lit(True))).alias("in_order"))
    read = back.agg(F.sum("okey").alias("sum_keys"), F.count_distinct("pub").alias("n_pubs")).crossJoin(turns)
    return read.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("n_rows", "n_exact", "n_with_pub", "n_with_locator")], "n_pubs", "sum_keys", "in_order")


MICRO = "array_to_string(list_transform(embedding, lambda x: round(x::double * 1000000)::bigint::varchar), ',')"


@query(
    "SRC15",
    f"with k as (select vec_id || ':' || {MICRO} as row from embeddings), hd as (" + digest_sql("row", "k", nested=True) + """)
  select version, case when version in ('v1', 'v2') then digest end as digest, n, state from hd, (values ('v1', 'superseded'), ('v1 on demand', 'loaded'), ('v2', 'loaded'), ('v3', 'changed'), ('reuse', 'v2'), ('reuse of another specification', 'none'), ('reuse for another population', 'none'), ('reuse of what is superseded', 'none'), ('reuse of what has changed', 'none'), ('reuse of a part', 'none')) t(version, state)""",
)
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature tables registered with a digest of their ids and vectors: one superseded, one current, one changed after it was registered."""
    source = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    micro = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))
    content = lambda df: set_digest(df, F.concat(F.col("vec_id").cast("string"), F.lit(":"), F.array_join(micro, ",")))
    base = rel.scratch(spark, "features")
    moved = F.when(F.col("vec_id") == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    rel.write_version(source, f"{base}/v1")
    rel.write_version(source, f"{base}/v2")
    rel.write_version(source.withColumn("embedding", moved), f"{base}/v3")
    digest = content(source).first()
    whole, some = (set_digest(df, F.col("vec_id").cast("string")).first()["digest"] for df in (source, source.where("vec_id % 2 = 0")))
    rel.write_version(source.where("vec_id % 2 = 0"), f"{base}/v4")
    key = lambda width, population=whole: rel.identity_key({"model": "vectors", "width": width}, population)
    entries = [("v1", "v2", key(32), True), ("v2", None, key(64), True), ("v3", None, key(128), True), ("v4", None, key(16), False)]
    registry = spark.createDataFrame([(name, f"{base}/{name}", digest["digest"], by, identity, whole_) for name, by, identity, whole_ in entries], "name string, path string, digest string, superseded_by string, identity string, complete boolean")
    states = []
    for name, allow in (("v1", False), ("v1", True), ("v2", False), ("v3", False)):
        try:
            rel.load_version(registry, name, content, allow)
            state = "loaded"
        except rel.VersionError as refused:
            state = "superseded" if "superseded" in str(refused) else "changed"
        states.append((f"{name} on demand" if allow else name, state))
    asked = {"reuse": key(64), "reuse of another specification": key(65), "reuse for another population": key(64, some), "reuse of what is superseded": key(32), "reuse of what has changed": key(128), "reuse of a part": key(16)}
    states += [(name, rel.find_reusable(registry, identity, content).name or "none") for name, identity in asked.items()]
    found = spark.createDataFrame(states, "version string, state string")
    return found.select("version", F.when(F.col("version").isin("v1", "v2"), F.lit(digest["digest"])).alias("digest"), F.lit(digest["n"]).cast("long").alias("n"), "state")


STREAMS = {
    "additions": "surplus and side = 'b'",
    "removals": "surplus and side = 'a'",
    "unresolved_additions": "surplus and side = 'b' and link = 'ambiguous'",
    "unresolved_removals": "surplus and side = 'a' and link = 'ambiguous'",
    "correction_candidates": "surplus and side = 'a' and link in ('entry_doi', 'reactant_set_id')",
    "identifier_conflicts": "surplus and side = 'a' and link = 'identifier_conflict'",
    "new_slots": "not in_a",
    "removed_slots": "not in_b",
    "ambiguous_slots": "link = 'ambiguous'",
}


@query(
    "SRC16",
    f"with {DIFF}, st as (" + " union all ".join(f"select '{name}' as stream, case when '{name}' like '%slots' then null else mtype end as mtype, ({SLOT}) as slot from d where {rule}" for name, rule in STREAMS.items()) + ") select stream, mtype, count(*) as n, count(distinct slot) as n_slots from (select * from st where stream not like '%slots' union all select distinct * from st where stream like '%slots') group by all",
)
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail of a comparison as nine named streams of JSON lines, in one pass: a row goes to each stream whose rule it meets, a slot once."""
    path = rel.scratch(spark, "detail")
    rows = rows_of(spark, sf_dir)
    names = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in STREAMS.items() if not name.endswith("slots")]))
    slots = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in STREAMS.items() if name.endswith("slots")]))
    slot = F.concat_ws("|", *SLOT.split(", "))
    records = rows.select(F.explode(names).alias("stream"), "mtype", slot.alias("slot"), "rel", "v", "doi", "rsid")
    named = rows.select(F.explode(slots).alias("stream"), F.lit(None).cast("string").alias("mtype"), slot.alias("slot")).distinct()
    records.unionByName(named, allowMissingColumns=True).write.partitionBy("stream").json(path)
    back = spark.read.schema("mtype string, slot string, stream string").json(path)
    return back.groupBy("stream", "mtype").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("n_slots"))


RANKING = ["rank", "item", "score", "shortlisted"]


@query("SRC17", "with r as (select p_partkey as item, p_size, row_number() over (order by p_size, p_partkey) as rank from part where p_size <= 20) select rank, item, p_size::varchar as score, p_size <= 10 as shortlisted, 3 as n_preamble, true as in_order from r")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking as CSV in rank order behind a preamble of comments and a header."""
    path = rel.scratch(spark, "ranking")
    kept = table(spark, sf_dir, "part").where("p_size <= 20").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("score"), (F.col("p_size") <= 10).alias("shortlisted"))
    ranking = rel.numbered_lines(kept, ["score", "item"], first=1).withColumnRenamed("line_no", "rank")
    rel.write_ranking(ranking, path, ["ranking of parts by size", "ties: smaller key first", "shortlist: size of 10 at most"], RANKING)
    back = rel.read_ranking(spark, path, RANKING)
    files = back.select(F.col("rank").cast("long").alias("rank"), F.input_file_name().alias("file")).groupBy("file").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    turns = files.withColumn("before", F.lag("most").over(Window.orderBy("file"))).agg(F.bool_and(F.coalesce(F.col("before") < F.col("least"), F.lit(True))).alias("in_order"))
    comments = spark.read.text(path).agg(F.count_if(F.col("value").startswith("#")).cast("int").alias("n_preamble"))
    return back.select(F.col("rank").cast("long").alias("rank"), F.col("item").cast("long").alias("item"), "score", F.col("shortlisted").cast("boolean").alias("shortlisted")).crossJoin(comments).crossJoin(turns)


@query(
    "SRC18",
    f"""with {OBS}, s as (select *, (('0x' || substr(md5(item::varchar), 1, 8))::bigint % 8)::int as shard from obs) select shard, count(*) as n_lines, count(distinct item) as n_keys, sum(okey)::bigint as sum_keys, true as verbatim, true as reconciles from s group by shard""",
)
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt over shards by a key, each as it stood: read, written and the sum over shards agree, and so do the lines' digests."""
    path = rel.scratch(spark, "shards")
    source = rel.scratch(spark, "lines")
    observations(spark, sf_dir).select(F.to_json(F.struct("okey", "line", "item", "grp", "rel", "v")).alias("value")).write.text(source)
    lines = spark.read.text(source)
    item = F.get_json_object("value", "$.item")
    rel.write_sharded(lines, path, item, 8)
    back = spark.read.schema("value string, shard int").text(path)
    content = F.sum(F.xxhash64("value").cast("decimal(38,0)"))
    per_shard = lambda df, shard: df.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), content.alias("c"), F.count_distinct(item).alias("n_keys"), F.sum(F.get_json_object("value", "$.okey").cast("long")).alias("sum_keys"))
    sent = per_shard(lines, rel.shard_of(item, 8)).select("shard", F.col("n").alias("n_sent"), F.col("c").alias("c_sent"))
    both = per_shard(back, F.col("shard")).join(sent, "shard", "full_outer")
    total = F.sum("n").over(Window.partitionBy()) == F.sum("n_sent").over(Window.partitionBy())
    return both.select("shard", F.col("n").alias("n_lines"), "n_keys", "sum_keys", (F.col("c") == F.col("c_sent")).alias("verbatim"), ((F.col("n") == F.col("n_sent")) & total).alias("reconciles"))


@query("SRC19", f"with {OBS} select count(*) * 2 as n from obs")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rel.scratch(spark, "bulk")
    rows = observations(spark, sf_dir).select("item", "grp", "v")
    rows.write.mode("append").parquet(path)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query(
    "AGG35",
    f"""with {GOOD}, o as (select line_no, okey from ordered), p as (select unnest(['item', 'grp', 'assay', 'relation', 'value', 'note']) as key, unnest([f1, f2, f3, f4, f5, f6]) as value from fields where not bad)
  select 'present' as section, key, count(*) filter (where value <> '') as n from p group by key union all select 'distinct', key, count(distinct nullif(value, '')) from p group by key
  union all select 'relation', case when f4 in ('<', '<=') then 'upper' when f4 in ('>', '>=') then 'lower' when f4 = '=' then 'exact' else 'other' end, count(*) from fields where not bad group by 2
  union all select 'excluded', case when okey % 103 = 0 then 'invalid_utf8' else 'field_count' end, count(*) from fields join o using (line_no) where bad group by 2""",
)
def agg35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a release: presence and different values by key, relations by pattern, exclusions by rule."""
    header, lines = read_back(spark, sf_dir)
    good, bad = rel.split_lines(lines, len(header))
    rows = rel.to_payload(good, header)
    cells = rows.select(F.explode("payload")).groupBy("key", "value").agg(F.count("*").alias("n"))
    by_key = cells.groupBy("key").agg(F.sum("n").alias("present"), F.count("*").alias("distinct")).unpivot("key", ["present", "distinct"], "section", "n")
    relation = F.col("payload")["relation"]
    pattern = F.when(relation.rlike("^<=?$"), "upper").when(relation.rlike("^>=?$"), "lower").when(relation == "=", "exact").otherwise("other")
    kinds = rows.groupBy(F.lit("relation").alias("section"), pattern.alias("key")).agg(F.count("*").alias("n"))
    rules = bad.groupBy(F.lit("excluded").alias("section"), F.col("rule").alias("key")).agg(F.count("*").alias("n"))
    return by_key.select("section", "key", "n").unionByName(kinds).unionByName(rules)


@query("UDF05", f"with {GOOD}, p as (select line_no, unnest(['item', 'grp', 'assay', 'relation', 'value', 'note']) as key, unnest([f1, f2, f3, f4, f5, f6]) as value, unnest(range(0, 6))::int as ordinal from fields where not bad) select line_no, key, value, ordinal from p where value <> ''")
def udf05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over all rows: the fields of their sparse maps with their places in the header."""
    header, lines = read_back(spark, sf_dir)
    good, _ = rel.split_lines(lines, len(header))
    return hooks.payload_entries(rel.to_payload(good, header), header, "line_no")


# scalar functions on texts


@query("SCA01", "select doc_id, sha256(regexp_replace(upper(replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 'ß', 'SS')), '[^\\x00-\\x7F]', '', 'g')) as digest from documents")
def sca01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sequence_digest(F.col("text")).alias("digest"))


PAGES = "pg as (select page_id, coalesce(html, '') as html from pages), " + entities_sql("pg", "page_id", "html")


@query("SCA02", f"with {PAGES} select page_id, length(html) as n_raw, length(decoded) as n_decoded, sha256(decoded) as decoded_sha256 from pg join decoded using (page_id)")
def sca02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities decoded beside the raw text, by built-in functions."""
    raw = F.coalesce("html", F.lit(""))
    found = table(spark, sf_dir, "pages").select("page_id", raw.alias("html"), decode_entities(raw).alias("decoded"))
    return found.select("page_id", F.length("html").cast("long").alias("n_raw"), F.length("decoded").cast("long").alias("n_decoded"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("SCA07", "select p_partkey as item, split_part(p_partkey || '_' || p_size, '_', 2)::int as second from part")
def sca07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split_part(F.concat_ws("_", "p_partkey", "p_size"), F.lit("_"), F.lit(2)).cast("int").alias("second"))


@query("SCA08", "select event_id, coalesce(trim(case when event_id % 3 = 0 then '  ' else event_type end), '') <> '' as present, nullif(trim(case when event_id % 3 = 0 then '  ' else event_type end), '') as kind from events")
def sca08(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.trim(F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", (F.coalesce(kind, F.lit("")) != "").alias("present"), F.nullif(kind, F.lit("")).alias("kind"))


@query("SCA09", "select event_id, (props->>'$.k')::int as k, json_exists(props, '$.k') as has_k, json_keys(props)[1] as first_key from events")
def sca09(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("int").alias("k"), k.isNotNull().alias("has_k"), F.json_object_keys("props")[0].alias("first_key"))


@query("SCA15", "select doc_id, length(coalesce(text, '')) as n, regexp_matches(coalesce(text, ''), '[0-9]') as has_digit, regexp_matches(coalesce(text, ''), '^[A-Za-z\\s.,]*$') as plain from documents")
def sca15(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), t.rlike("[0-9]").alias("has_digit"), t.rlike(r"\A[A-Za-z\s.,]*\z").alias("plain"))


@query("SCA18", f"with {OBS} select case when n >= 10 then '10+' else n::varchar end as bucket, count(*) as n_pairs from (select item, count(*) as n from obs group by item) group by 1")
def sca18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = observations(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 10, "10+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count("*").alias("n_pairs"))


@query("SCA19", "select p_partkey as item, contains(p_name, 'ring') as has_ring, starts_with(p_name, 'red') as is_red, p_name like '%bolt' as is_bolt, regexp_matches(p_brand, '#1[0-9]$') as teen_brand from part")
def sca19(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), n.contains("ring").alias("has_ring"), n.startswith("red").alias("is_red"), n.like("%bolt").alias("is_bolt"), F.col("p_brand").rlike("#1[0-9]$").alias("teen_brand"))


@query("SCA20", "select l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) as rounded from lineitem")
def sca20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 3).alias("rounded"))


SEQ = "sq as (select doc_id, translate(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as s from documents)"


@query(
    "PRJ19",
    f"""with {SEQ} select doc_id, length(s) as n, array_to_string(list_filter([case when s = '' then 'empty' end, case when regexp_matches(s, '[0-9]') then 'digits' end, case when regexp_matches(s, '[^A-Z]') then 'illegal' end, case when length(s) > 1022 then 'too_long' end], lambda x: x is not null), ',') as errors,
  case when s <> '' and regexp_matches(s, '^[ACGTUN]+$') then 'looks_like_nucleotides' else '' end as notes from sq""",
)
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ascii_upper(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    seqs = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    c = F.col("s")
    errors = F.array_compact(F.array(F.when(c == "", "empty"), F.when(c.rlike("[0-9]"), "digits"), F.when(c.rlike("[^A-Z]"), "illegal"), F.when(F.length(c) > 1022, "too_long")))
    notes = F.when((c != "") & c.rlike("^[ACGTUN]+$"), "looks_like_nucleotides").otherwise("")
    return seqs.select("doc_id", F.length(c).cast("long").alias("n"), F.array_join(errors, ",").alias("errors"), notes.alias("notes"))


@query("AGG36", f"with {SEQ}, n as (select doc_id, length(s) as n, row_number() over (order by length(s), doc_id) - 1 as r, count(*) over () as k from sq where s <> '') select min(n) as least, max(n) filter (where r = k // 2) as upper_median, max(n) as most, count(*) filter (where n > 1022) as n_over, (select string_agg(n.doc_id || ':' || n.n, ',' order by p) from n, range(0, 10) t(p) where n.r = p * n.k // 10) as sample from n")
def agg36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length statistics and ten sequences at equal steps of rank. The median comes from counts by length, the ten from counts of ranges."""
    s = F.length(ascii_upper(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")))
    lengths = write_once(table(spark, sf_dir, "documents").select("doc_id", s.cast("long").alias("n")).where("n > 0"), "lengths")
    counts = lengths.groupBy("n").agg(F.count("*").alias("c"))
    running = counts.withColumn("upto", F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.sum("c").over(Window.partitionBy()))
    found = running.agg(F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("k") / 2), F.col("n"))).alias("upper_median"), F.max("n").alias("most"), F.sum(F.when(F.col("n") > 1022, F.col("c")).otherwise(0)).alias("n_over"))
    spaced = evenly_spaced(lengths, "n", "doc_id", 10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n").cast("long").cast("string")).alias("x")))), lambda x: x["x"]), ",").alias("sample"))
    return found.crossJoin(spaced)
