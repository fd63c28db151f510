"""Fill-in-the-middle: a document is cut in three by unit ordinals, and its parts are put in another order with markers.

Units are the matches of a pattern that tiles a text (code points by default). They are rows: matches are exploded with
their places, windows hold the running sums of their numbers and lengths, cut requests meet them by unit ordinal, offsets
are aggregated per document, and substrings are taken. A row is a run of up to ``run`` units, one match of the repeated
pattern, so that a text isn't multiplied by the width of a row; of a run that a cut falls into, the units before the cut
are counted in the document's own row. ``run=1`` is a row for each unit.

Every row of the documents gets a key of its own, its place in the input; texts travel once, by that key, and runs,
requests and the final join use that one exchange. No text is sorted. Rows that come in another order when they are
computed again, as after a shuffle, are written first; those of files aren't (``from_files``).

Edge cases: null and empty texts are plain; a null doc_id is hashed as an empty one; repeated rows are cut once each, all
alike; a text that holds a marker stays plain, so that outputs can be taken apart again; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, load, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RUN, SEED, PLAIN_FROM, SPM_BELOW = 64, "1", 90, 20


def _runs_of(unit: str, run: int) -> str:
    return f"(?s){unit}{{1,{run}}}" if len(unit) == 1 else f"(?s)(?:{unit}){{1,{run}}}"


def _count(text: Column, unit: str) -> Column:
    return F.char_length(text) if unit == "." else F.regexp_count(text, F.lit(f"(?s){unit}"))


def _digits(group: int, seed: str) -> Column:
    """A group of eight hexadecimal digits of the document's hash, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def _form(seed: str, plain_from: int, spm_below: int) -> Column:
    marked = F.col("text").rlike("|".join(re.escape(m) for m in (PREFIX, SUFFIX, MIDDLE)))
    plain = (F.col("text") == "") | marked | (_digits(3, seed) % 100 >= plain_from)
    return F.when(plain, "plain").when(_digits(4, seed) % 100 < spm_below, "spm").otherwise("psm")


def unit_runs(docs: DataFrame, unit: str = ".", run: int = RUN) -> DataFrame:
    """key, units_before, units, chars_before, chars: each run of units with what stands before it. docs: key, doc_id, text."""
    found = docs.select("key", "doc_id", F.regexp_extract_all("text", F.lit(_runs_of(unit, run)), F.lit(0)).alias("found"))
    # the outer form: else Spark would match every text once more beneath the exchange, to drop empty ones
    rows = found.select("key", "doc_id", F.size("found").alias("n_runs"), F.posexplode_outer("found").alias("place", "match"))
    units = F.when(F.col("place") + 1 < F.col("n_runs"), F.lit(run)).otherwise(_count(F.col("match"), unit)).cast("long")
    rows = rows.select("key", "doc_id", "place", units.alias("units"), F.char_length("match").cast("long").alias("chars"))
    before = Window.partitionBy("key", "doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("units", "chars")}
    return rows.select("key", "units", "chars", *[v.alias(k) for k, v in sums.items()])


def cut_requests(docs: DataFrame, unit: str, seed: str, plain_from: int, spm_below: int) -> DataFrame:
    """key, cut (0 or 1), ordinal: after how many units a document is cut; plain ones aren't. docs: key, doc_id, text."""
    n = _count(F.col("text"), unit).cast("long")
    # not a filter, which would move beneath the exchange and make it another one
    plain = _form(seed, plain_from, spm_below) == "plain"
    asked = docs.select("key", F.when(plain, 0).otherwise(n).alias("n"), _digits(1, seed).alias("a"), _digits(2, seed).alias("b"))
    ends = [F.expr(f"{x} % (n + 1)") for x in "ab"]
    cuts = [F.struct(F.lit(i).alias("cut"), pick(*ends).alias("ordinal")) for i, pick in enumerate((F.least, F.greatest))]
    return asked.select("key", F.inline(F.array(*cuts)))


def fill_in_middle(docs: DataFrame, unit: str = ".", run: int = RUN, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, from_files: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output."""
    src = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = src.withColumn("key", F.monotonically_increasing_id())
    if not from_files:
        keyed = written(keyed, "middle").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("key", F.lit(-1).cast("long")).alias("key"))
    dealt = keyed.select("key", "doc_id", "text").repartition("key")
    runs, asked = unit_runs(dealt, unit, run), cut_requests(dealt, unit, seed, plain_from, spm_below)
    hit = runs.join(asked, "key").where("ordinal > units_before and ordinal <= units_before + units")
    # what a cut needs: where its run starts and ends, and how many of the run's units lie before the cut
    place = {"at": F.col("chars_before"), "size": F.col("chars"), "wanted": F.col("ordinal") - F.col("units_before")}
    offsets = hit.groupBy("key").agg(*[F.sum(F.when(F.col("cut") == i, v)).alias(f"{k}{i}") for i in (0, 1) for k, v in place.items()])

    def offset(i: int) -> Column:
        at, size, wanted = (F.col(f"{c}{i}") for c in place)
        if unit == "." or run == 1:
            inside = F.when(wanted > 0, size if run == 1 else wanted)
        else:
            units = F.regexp_extract_all(F.substring(F.col("text"), (at + 1).cast("int"), size.cast("int")), F.lit(f"(?s){unit}"), F.lit(0))
            inside = F.aggregate(F.slice(units, 1, wanted.cast("int")), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
        return F.coalesce(at + inside, F.lit(0)).cast("int")

    whole = dealt.join(offsets.hint("shuffle_hash"), "key", "left").select(
        "doc_id", "text", _count(F.col("text"), unit).cast("long").alias("n"), _form(seed, plain_from, spm_below).alias("form"), offset(0).alias("o0"), offset(1).alias("o1")
    )
    cut = F.col("form") != "plain"
    return whole.select(
        "doc_id", "n", "form", F.when(cut, F.col("o0")).cast("long").alias("prefix_chars"), F.when(cut, F.col("o1") - F.col("o0")).cast("long").alias("middle_chars"),
        F.expr(
            f"""CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN concat('{PREFIX}', substring(text, 1, o0), '{SUFFIX}', substring(text, o1 + 1), '{MIDDLE}', substring(text, o0 + 1, o1 - o0))
            ELSE concat('{SUFFIX}', substring(text, o1 + 1), '{PREFIX}', substring(text, 1, o0), '{MIDDLE}', substring(text, o0 + 1, o1 - o0)) END"""
        ).alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone."""
    between = {}
    for name, (a, b) in {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}.items():
        first = f"substring({output}, {len(a) + 1}, instr({output}, '{b}') - {len(a) + 1})"
        second = f"substring({output}, instr({output}, '{b}') + {len(b)}, instr({output}, '{MIDDLE}') - instr({output}, '{b}') - {len(b)})"
        last = f"substring({output}, instr({output}, '{MIDDLE}') + {len(MIDDLE)})"
        between[name] = f"concat({first}, {last}, {second})" if name == "psm" else f"concat({second}, {last}, {first})"
    return F.expr(f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN {between['psm']} ELSE {between['spm']} END")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents"), from_files=True)
    hashes = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored())]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashes[0].alias("output_sha256"), hashes[1].alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, least(a, b) AS o0, greatest(a, b) AS o1, substring(text, 1, least(a, b)) AS pre, substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substring(text, greatest(a, b) + 1) AS suf FROM g
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(o0 AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(o1 - o0 AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
