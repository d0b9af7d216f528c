"""Fill-in-middle: texts cut at two hashed places and rearranged round sentinels, in DataFrame operations alone.

regexp_extract_all makes the array of a text's units, groups of hex digits of
a sha256 of seed and id give the cuts, the form and whether a text is left
plain; slice and array_join build the arrangement. Reading it parts the
output at its sentinels. That is exact: texts that hold a sentinel stay plain,
and no sentinel can arise where a text meets one, as each begins with "<",
ends with ">" and has neither inside.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SEED = 1
#: Of 100 texts so many are rearranged, and of 100 of these so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: What opens the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, unit: str = UNIT) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): one row a document.

    n counts the units that `unit` cuts a text into, which must cover it. form
    is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain. A
    null text is empty, an empty text plain; a null id counts as an empty one
    in the hash. Repeated rows are rearranged alike, texts of any length are
    taken whole, extra columns are ignored, and an empty table gives an empty
    result. Lengths count code points and are null for plain rows.
    """
    if any(not re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError("a sentinel is a text in angle brackets, with none inside")
    p, s, m = map(F.lit, sentinels)
    d = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text__"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256).alias("h__"))
    d = d.withColumn("units__", F.regexp_extract_all("text__", F.lit(unit), F.lit(0)))
    d = d.withColumn("n", F.size("units__").cast("long"))
    held = F.col("text__").contains(p) | F.col("text__").contains(s) | F.col("text__").contains(m)
    plain = (F.col("n") == 0) | held | (_draw(F.col("h__"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("h__"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [(_draw(F.col("h__"), i) % (F.col("n") + 1)).cast("int") for i in (0, 1)]
    d = d.select(id_col, "text__", "units__", "n", form.alias("form"), F.least(*cuts).alias("lo__"), F.greatest(*cuts).alias("hi__"))
    cut = F.col("form") != "plain"
    joined = lambda start, length: F.when(cut, F.array_join(F.slice("units__", start, length), ""))
    d = d.select(
        id_col, "text__", "n", "form",
        joined(F.lit(1), F.col("lo__")).alias("prefix__"),
        joined(F.col("lo__") + 1, F.col("hi__") - F.col("lo__")).alias("middle__"),
        joined(F.col("hi__") + 1, F.col("n").cast("int") - F.col("hi__")).alias("suffix__"),
    )
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix__", s, "suffix__", m, "middle__")).when(F.col("form") == "spm", F.concat(s, "suffix__", p, "prefix__", m, "middle__")).otherwise(F.col("text__"))
    return d.select(id_col, "n", "form", F.length("prefix__").cast("long").alias("prefix_chars"), F.length("middle__").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made of."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
b AS (
  SELECT doc_id, text, u, len(u) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS r FROM a),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
      WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM b),
d AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM d"""
