"""Removal of repeated multi-line chunks, with DataFrame and SQL functions only.

A text's units are its non-empty lines, each with the empty ones after it (those that open a text are a unit of their own).
A rolling hash over the last two units is known after each unit, and a chunk ends where it is smaller than after the unit
before and after the one behind: a shift moves boundaries only next to it. No chunk of a text of two or more units has fewer
than two. Chunks are counted over all texts by digest and length. Of each chunk that occurs again, all but the first
occurrence (smallest id, then place) are removed, after their bytes are compared with the first one's. Only chunks of two or
more non-empty lines can go.

What moves between machines is digests and places; texts move to those of their chunks that repeat, and repeated chunks to
their first occurrence, by the same plan at any size. Rows are told apart by id and a hash of their text.

Null texts stay null and have no lines; empty ones have one empty line. Rows with a null id are compared like others but
come last as an occurrence. Rows of equal id and unequal texts are rows of their own, the smaller hash first. Repeated rows
count as one occurrence, so that all keep or lose a chunk alike. Long texts are cut within their row; no group is ever
gathered. An empty table gives an empty result. Further columns are left alone, except those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: The chunks of a text, as arrays of units. Binds each value once: units, their hashes, rolling hashes, ends of chunks.
CHUNKS = r"""
transform(array(split(text, '\n(?=[^\n])', -1)), us ->
 transform(array(transform(us, u -> md5(u))), hs ->
  transform(array(transform(hs, (h, i) -> if(i = 0, '', md5(concat(hs[i - 1], h))))), rs ->
   transform(array(array_append(if(size(rs) < 5, array(), filter(sequence(3, size(rs) - 2), i -> rs[i - 1] < rs[i - 2] and rs[i - 1] < rs[i])), size(rs))), es ->
    transform(es, (e, j) -> slice(us, if(j = 0, 1, es[j - 1] + 1), e - if(j = 0, 0, es[j - 1])))
   )[0])[0])[0])[0]
"""
#: Whether such a chunk may go; its text; the lines of a text.
MAY_GO = r"size(filter({}, u -> u <> '' and substr(u, 1, 1) <> '\n')) >= 2"
TEXT = r"array_join({}, '\n')"
LINES = r"(length({0}) - length(replace({0}, '\n', '')) + 1)"
#: The hash that tells rows of one id apart.
MARK = "xxhash64(text)"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos) of each chunk that repeats an earlier one, for docs(doc_id, text)."""
    docs, chunk, digest = docs.where("text is not null"), F.col("chunk"), ["digest", "size"]
    cut = docs.select("doc_id", F.expr(MARK).alias("mark"), F.posexplode(F.expr(CHUNKS)).alias("pos", "units")).where(MAY_GO.format("units"))
    keys = written(cut.withColumn("chunk", F.expr(TEXT.format("units"))).select("doc_id", "mark", "pos", F.md5(chunk).alias("digest"), F.octet_length(chunk).alias("size")), "chunk-keys")
    # A chunk's place in the order of occurrences; a null id comes last.
    place = F.coalesce(F.col("doc_id").cast("decimal(28,0)"), F.lit("9" * 27).cast("decimal(28,0)")) * 1_000_000_000 + F.col("pos")
    place = place.cast("decimal(38,0)")
    again = keys.groupBy(*digest).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    again = again.where("first < last or low < high").select(*digest, "first")
    hits = keys.join(again.hint("merge"), digest).select("doc_id", "mark", "pos", *digest, (place == F.col("first")).alias("leads"))
    hits = written(hits.distinct(), "repeated-chunks")

    wanted = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("pos", *digest, "leads")).alias("wanted"))
    texts = docs.select("doc_id", "text", F.expr(MARK).alias("mark"))
    held = joined(texts, wanted, "inner").select("doc_id", "mark", F.explode(F.expr(f"transform(array({CHUNKS}), cs -> transform(wanted, w -> named_struct('w', w, 'chunk', {TEXT.format('cs[w.pos]')})))[0]")).alias("x"))
    held = written(held.select("doc_id", "mark", "x.w.*", "x.chunk"), "chunk-texts")
    leaders = written(held.where("leads").groupBy(*digest).agg(F.min(F.struct("mark", "chunk")).alias("kept")), "chunk-leaders")
    gone = held.join(leaders.hint("merge"), digest).where("chunk = kept.chunk and not (leads and mark = kept.mark)")
    gone = written(gone.select("doc_id", "mark", "pos").distinct(), "removed-chunks")
    dropped(keys, hits, held, leaders)
    return gone


def joined(rows: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """rows with what is known of them by id and mark."""
    other = marked.withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark")
    return rows.join(other.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), how).drop("__id", "__mark")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated chunks taken out of their text, and n_lines, n_removed_lines, n_removed_chunks."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeats(own).groupBy("doc_id", "mark").agg(F.collect_list("pos").alias("__gone"))
    spare = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed_lines", "n_removed_chunks")]
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("__none"), *spare).alias("__rest"))
    rows = joined(held.withColumn("mark", F.expr(MARK)), gone, "left")
    # One struct for each text: what stays, and how many chunks do.
    stays = F.expr(
        f"""if(__gone is null, named_struct('text', text, 'any', true, 'chunks', 0),
        transform(array({CHUNKS}), cs -> transform(array(transform(array_except(sequence(0, size(cs) - 1), __gone), i -> cs[i])), ks ->
          named_struct('text', {TEXT.format("flatten(ks)")}, 'any', size(ks) > 0, 'chunks', size(cs) - size(ks)))[0])[0])"""
    )
    out = rows.select("doc_id", "text", "__rest", F.explode(F.array(stays)).alias("__s"))

    def column(c: str) -> Column:
        return F.col("doc_id") if c == id_col else F.col("__s.text") if c == text_col else F.col(f"__rest.{c}")

    columns = [column(c).alias(c) for c in docs.columns if c in spare or c in (id_col, text_col)]
    before, after = (F.expr(f"cast({LINES.format(t)} as long)") for t in ("text", "__s.text"))
    left = F.when(F.col("__s.any"), after).otherwise(0)
    return out.select(*columns, F.coalesce(before, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(before - left, F.lit(0)).cast("long").alias("n_removed_lines"), F.col("__s.chunks").cast("long").alias("n_removed_chunks"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
owned AS (
  SELECT *, sum((line <> '')::int) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM lines),
units AS (
  SELECT doc_id, u, count(*) AS n, bool_or(line <> '') AS filled, string_agg(line, chr(10) ORDER BY i) AS unit FROM owned GROUP BY doc_id, u),
hashed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS size, md5(lag(md5(unit)) OVER w || md5(unit)) AS r FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
cuts AS (
  SELECT *, i >= 3 AND i <= size - 2 AND r < lag(r) OVER w AND r < lead(r) OVER w AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (
  SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM cuts),
chunks AS (
  SELECT doc_id, pos, sum(n) AS n, string_agg(unit, chr(10) ORDER BY i) AS chunk, count(*) FILTER (filled) >= 2 AS may_go FROM placed GROUP BY doc_id, pos),
ranked AS (
  SELECT *, may_go AND row_number() OVER (PARTITION BY chunk, may_go ORDER BY doc_id, pos) > 1 AS gone FROM chunks)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  count(*) FILTER (gone) AS n_removed_chunks, md5(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM documents d LEFT JOIN ranked r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
