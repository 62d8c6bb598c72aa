"""Queries of the manifest, the chat format and the periodic runs over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import chat, merkle, periodic_runs
from arcloom.llm.registry import query, table

# crc32 of an integer as decimal text, by the usual table of 256 entries; the name of the integer is put in
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(name: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({name} AS VARCHAR), ''), lambda x: "
            "CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)")


def _leaf_sql(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {_crc("doc_id")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS shown
  FROM documents, crc),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
-- all levels of each language's tree, a list of nodes each
g AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i:
           sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM g WHERE len(nodes) > 1),
s AS (
  SELECT lang, nodes[1] AS subroot, level AS height,
         row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM g WHERE len(nodes) = 1),
-- the same over the languages' roots
u AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i:
           sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM u WHERE len(nodes) > 1),
-- from each leaf up to the root: the node below, its sibling, the node above
w AS (
  SELECT p.doc_id, p.lang, p.leaf, s.subroot, s.height, s.place AS top,
         CASE WHEN s.height = 0 THEN s.place ELSE p.place END AS spot, 0 AS level, '' AS proof,
         p.shown AS folded
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, lang, leaf, subroot, height, top,
         CASE WHEN level + 1 = height THEN top ELSE spot // 2 END, level + 1,
         proof || coalesce(other, ''),
         CASE WHEN spot % 2 = 1 THEN sha256(coalesce(other, '') || folded) ELSE sha256(folded || coalesce(other, '')) END
  FROM (
    SELECT w.*, CASE WHEN w.level < w.height THEN g.nodes[CAST(xor(w.spot, 1) AS BIGINT) + 1]
                     ELSE u.nodes[CAST(xor(w.spot, 1) AS BIGINT) + 1] END AS other
    FROM w LEFT JOIN g ON w.level < w.height AND w.lang IS NOT DISTINCT FROM g.lang AND w.level = g.level
           LEFT JOIN u ON w.level >= w.height AND w.level - w.height = u.level
    WHERE w.level < w.height + (SELECT max(level) FROM u))),
r AS (SELECT nodes[1] AS root, level FROM u WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM w, r
WHERE w.level = w.height + r.level"""


def _unsigned_crc(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary"))


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(_unsigned_crc() % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
                        "folded_root", "verified")


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, replace(replace(role, '\', '\s'), '<|', '<\p|') AS erole, replace(replace(text, '\', '\s'), '<|', '<\p|') AS etext
  FROM c),
o AS (
  SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS before
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256,
       CAST(sum(len(etext) + CASE WHEN nth = 1 OR role <> before THEN len(erole) + len('<|start|><|text|><|end|>')
                                  ELSE len('<|part|>') END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""


@query("op12_chat_format", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    chats = chat.format_chats(turns.unionByName(more))
    back = chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                        chat.loss_text(F.col("segments")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


OP13_SQL = rf"""
WITH {_CRC_TABLE},
h AS (SELECT doc_id, text, {_crc("doc_id")} AS h FROM documents, crc),
o AS (
  SELECT doc_id, h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM h),
e AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a,
         CASE WHEN h % 10 = 0 AND len(words) > 0
              THEN 1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8) ELSE 1 END AS p
  FROM o),
w AS (
  SELECT doc_id, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM (SELECT doc_id, words, a, p, unnest(range(n)) AS i FROM e)),
-- pairs of equal words; those in a row at one distance q are a stretch of period q
m AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
  JOIN e ON e.doc_id = x.doc_id WHERE y.i - x.i <= e.n // 2),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
r AS (
  SELECT doc_id, start, length, min(q) AS period
  FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island)
  WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
f AS (
  SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, q := period), (length, -start, -period)) AS best,
         sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM w ANTI JOIN x USING (doc_id, i)
  GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       CAST(floor(1000 * best.l // best.q) AS BIGINT) AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM e LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)"""


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The text of a tenth of the rows, chosen by their id, repeats a stretch of its words from some word on to its end."""
    h = _unsigned_crc(id_column)
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.withColumn(text, F.when(h % 10 == 0, planted).otherwise(F.col(text)))


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs, collapsed=None, collapsed_sha256="collapsed_sha256").drop("text")
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda acc, r: F.when(
        acc.isNull() | (r["length"] > acc["length"]), r).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("__best.start").alias("start"),
        F.col("__best.length").alias("length"), F.col("__best.period").alias("period"),
        F.expr("1000 * `__best`.length div `__best`.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed_sha256")
