"""Near copies: documents joined on the Jaccard similarity of their word shingles, by rare-first prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..similarity.set_join import linked_classes, named_components


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Link the documents whose sets of lower-cased word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns a row a document: doc_id, n_shingles, component_id (the smallest doc_id that links reach). Prefixes hold the
    rarest shingles; length, positional and suffix filters come before a pair's one comparison (``linked_classes`` says how).

    A null or empty text, or one of white space, has no shingle and links with nothing. Rows that share an id are nodes
    of their own set but name the same id. A null id stays null; it names no component, so one of null ids alone has a
    null component_id. A text of fewer words has its whole sequence as one shingle. An empty table gives an empty one.
    Other columns are not read. Shingles and sets are told apart by 64-bit hashes: two of a billion different sets are
    taken for equal with odds of 3 percent.
    """
    rows, roots = linked_classes(docs, words, percent, id_col, text_col, parts)
    return named_components(rows, roots).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: By all pairs that share a shingle: 20 seconds for a thousand documents.
SQL = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l as (select x, y from p union all select y, x from p),
r as (select doc_id as node, doc_id as reach from documents union select l.x, r.reach from l join r on r.node = l.y)
select s.doc_id, len(sh)::bigint as n_shingles, min(r.reach) as component_id from s join r on r.node = s.doc_id group by s.doc_id, len(sh)
"""
