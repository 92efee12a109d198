"""Fill-in-middle transformation (operator 13): escaped marker injection.

DataFrame functions only, row by row. A delimiter is escaped in the text, a regular expression appends it after each unit, counting it
counts the units, and substring_index takes the units before, between and after two cuts; each part is unescaped and the parts are put
together behind their markers. A unit is a word with the blanks before it, or the blanks at the end. Cuts and forms come from a hash
of seed and id, so they don't depend on how rows are dealt.

A null text counts as empty, and an empty one stays plain; a null id hashes as the empty string; rows with equal ids get equal draws;
an empty table gives an empty one; columns of any name are kept in `row`. A text that holds a marker stays plain, as it could not be
told from a transformed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.shared import dealt_documents, hex_sha256

UNIT = "[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++|[\\x20\\x09-\\x0D]++"
#: The delimiter and what escapes it; neither is blank, so escaping leaves units as they are.
DELIMITER, ESCAPE = "\x1f", "\x1e"
#: Of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SUFFIX_FIRST = 42, 50, 80


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """The text of a part; delimiters that were injected go."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def before(text: Column, delimiter: str, count: Column) -> Column:
    """substring_index, with a column as its count."""
    return F.call_function("substring_index", text, F.lit(delimiter), count.cast("int"))


def draws(id_col: str, seed: int) -> Column:
    """Four numbers of 32 bits from the hash of seed and id."""
    hexed = hex_sha256(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.array(*(F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """row (all columns of docs), n (units), form, prefix, middle, suffix (null where plain) and output.

    rate: percentage of texts that are transformed; suffix_first: percentage of those in the form spm (suffix, prefix, middle), the
    others being psm (prefix, suffix, middle).
    """
    p, s, m = (F.lit(x) for x in MARKERS)
    work = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), draws(id_col, seed).alias("_h"))
    work = work.withColumn("_marked", F.regexp_replace(escaped(F.col("_text")), UNIT, "$0" + DELIMITER))
    work = work.withColumn("n", (F.length("_marked") - F.length(F.replace("_marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    holds = F.contains("_text", p) | F.contains("_text", s) | F.contains("_text", m)
    plain = (F.col("_text") == "") | holds | (F.get("_h", F.lit(2)) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("_h", F.lit(3)) % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [F.get("_h", F.lit(k)) % (F.col("n") + 1) for k in (0, 1)]
    work = work.withColumn("form", form).withColumn("_lo", F.least(*cuts)).withColumn("_hi", F.greatest(*cuts))
    lo, hi, n = F.col("_lo"), F.col("_hi"), F.col("n")
    parts = {
        "prefix": before(F.col("_marked"), DELIMITER, lo),
        "middle": before(before(F.col("_marked"), DELIMITER, hi), DELIMITER, lo - hi),
        "suffix": before(F.col("_marked"), DELIMITER, hi - n - 1),  # the marked text ends with a delimiter
    }
    work = work.select("row", "_text", "n", "form", *(F.when(F.col("form") != "plain", unescaped(x)).alias(c) for c, x in parts.items()))
    spm = F.concat(s, F.col("suffix"), p, F.col("prefix"), m, F.col("middle"))
    psm = F.concat(p, F.col("prefix"), s, F.col("suffix"), m, F.col("middle"))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return work.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: markers can't occur in parts, nor across their ends."""
    p, s, m = MARKERS
    first = F.substring(F.substring_index(output, m, 1), len(p) + 1, 1 << 30)  # both forms begin with a marker of three characters
    left = {"psm": F.substring_index(first, s, 1), "spm": F.substring_index(first, p, -1)}
    right = {"psm": F.substring_index(first, s, -1), "spm": F.substring_index(first, p, 1)}
    middle = F.substring_index(output, m, -1)
    text = lambda kind: F.concat(left[kind], middle, right[kind])
    return F.when(form == "plain", output).when(form == "spm", text("spm")).otherwise(text("psm"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(dealt_documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "row.doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        hex_sha256(F.col("output")).alias("output_sha256"), hex_sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL13 = r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as hex
  from documents),
drawn as (
  select *, len(u) as n, cast('0x' || substr(hex, 1, 8) as bigint) as h1, cast('0x' || substr(hex, 9, 8) as bigint) as h2, cast('0x' || substr(hex, 17, 8) as bigint) as h3, cast('0x' || substr(hex, 25, 8) as bigint) as h4
  from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, coalesce(array_to_string(u[1:lo], ''), '') as prefix, coalesce(array_to_string(u[lo + 1:hi], ''), '') as middle, coalesce(array_to_string(u[hi + 1:n], ''), '') as suffix
  from cut)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {"op13_fill_in_middle": SQL13}
