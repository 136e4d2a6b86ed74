"""Fill-in-the-middle examples: texts cut at unit boundaries and put together anew around sentinels, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed, table, with_names

#: Unit grammars: the character classes whose runs are one unit each; any other code point is a unit of its own.
LETTERS, WORDS, LINES, CHARACTERS = ("A-Za-z",), (r"^\x20\x09-\x0D",), (r"^\n",), ()
#: What marks prefix, suffix and middle in an example.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that become examples, and of these the percent that put the suffix first.
RATE, SPM = 90, 20


def boundary(runs: tuple[str, ...]) -> str:
    """The zero-width regex of the places between two units, for a grammar of disjoint character classes (what stands between the brackets of a class).

    Between two characters there is no boundary if one class holds both; never one at either end of a text."""
    other = lambda c: c[1:] if c.startswith("^") else f"^{c}"
    leaves = [f"(?<=[{c}])(?=[{other(c)}])" for c in runs]
    rest = "".join(f"(?![{c}])" for c in runs)
    # behind a character of no class: any character may follow. (?<=...) looks at one code point, of which none of the classes holds
    lone = rf"(?<={rest}[\s\S])(?=[\s\S])"
    return "|".join([*leaves, lone])


def units(text: Column, runs: tuple[str, ...] = LETTERS) -> Column:
    """The units of a text in order; together they are the text. A null or empty text has none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(runs)))


def _share(digest: Column, group: int) -> Column:
    """A group of 8 hexadecimal digits, from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("bigint")


def examples(docs: DataFrame, key: str = "doc_id", text: str = "text", runs: tuple[str, ...] = LETTERS, seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    Two cuts between units fall by the digest of seed and key, so reruns and rows of equal keys agree whatever the layout. A text that is
    empty or holds a sentinel stays plain, and so do 100 - rate percent of the others. A null text is empty; a null key is written as
    nothing; rows that repeat a key share its numbers, each on its own text. Very long texts are cut whole: a task holds one text's units at a
    time. An empty table gives no rows. Columns of docs called n, form, prefix, middle, suffix or output are replaced."""
    df, at = renamed(docs)
    kept = [F.col(name) for name in at.values()]
    whole = F.coalesce(F.col(at[text]), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(at[key]).cast("string"), F.lit(""))), 256)
    cut = df.select(*kept, whole.alias("whole"), units(whole, runs).alias("units"), *[_share(digest, i).alias(f"h{i + 1}") for i in range(4)])
    n = F.size("units")
    marked = F.col("whole").contains(PREFIX) | F.col("whole").contains(SUFFIX) | F.col("whole").contains(MIDDLE)
    plain = (F.col("whole") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    first, second = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
    placed = cut.select(*kept, "whole", "units", n.cast("bigint").alias("n"), form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    run = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    lo, hi = F.col("a"), F.col("b")
    parts = placed.select(*kept, "whole", "n", "form", run(F.lit(1), lo).alias("prefix"), run(lo + 1, hi - lo).alias("middle"), run(hi + 1, F.size("units") - hi).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_form = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_form).otherwise(F.col("whole"))
    return with_names(parts, at, {"n": F.col("n"), "form": F.col("form"), "prefix": F.col("prefix"), "middle": F.col("middle"), "suffix": F.col("suffix"), "output": output})


def restored(output: Column, form: Column) -> Column:
    """The text of an example, from its output and form alone. No sentinel stands inside its pieces, and sentinels can't overlap, so the first of each is the true one."""
    inside = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(inside(PREFIX, SUFFIX), last, inside(SUFFIX, MIDDLE))
    spm = F.concat(inside(PREFIX, MIDDLE), last, inside(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle examples. A null or empty text is plain; rows of a repeated or null doc_id share its numbers; very long texts are cut whole; an empty table gives no rows."""
    made = examples(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.length(c).cast("bigint")
    return made.select("doc_id", "n", "form", size("prefix").alias("prefix_chars"), size("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
