"""Personal data (operator 2): patterns propose spans, checksums confirm them, nearby context words adjust their scores.

DataFrame functions only. Positions come from splitting a text at a pattern's matches: lengths of gaps and matches add up to them.
The patterns use possessive repeats and refuse to start inside a run that already failed, which changes no match but keeps the work
linear in the text; what compares spans with each other sorts them and takes running maxima, n log n in their number.

Null texts count as empty (and stay null in redact); ids may be null or repeat, as each row is judged alone; an empty table gives an
empty one; a column named like the result gives way, all others stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import columns
from glossmill.llm.shared import dealt_documents

# Length of each country's IBAN.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """Countries of one length share an alternative, so that a word after a number isn't taken for a part of it."""
    by_length = {n: "|".join(c for c, own in IBAN_LENGTHS.items() if own == n) for n in sorted(set(IBAN_LENGTHS.values()))}
    ways = "|".join(rf"(?:{names})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in by_length.items())
    return rf"(?<![A-Za-z0-9])(?:{ways})(?![A-Za-z0-9])"


# Kinds in order, their patterns and the cheap test that a text must pass to be searched at all.
MAILBOX = "[A-Za-z0-9._%+-]"
KINDS: dict[str, tuple[str, str]] = {
    "email": (rf"(?:\G|(?<!{MAILBOX})){MAILBOX}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (iban_pattern(), r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "local_phone": (r"(?<![0-9+.-])[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[.-][0-9]{3}[.-]"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed candidate, and the words that raise it by CONTEXT within NEAR characters before it (and after its kind's last
#: match). Kinds of a checksum stand without; those of digits alone need a word.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4, "local_phone": 0.4}
WORDS = {
    "email": "mail|contact", "ip": "address|server|host", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|mobil",
    "iban": "iban|account|konto|compte|cuenta", "national_id": "ssn|social security|national id|identity", "local_phone": "phone|tel|call|mobil|fax",
}
CONTEXT, NEAR, LEAST = 0.2, 40, 0.6


def confirmed(kind: str, text: Column) -> Column:
    """Whether the checksum or range rule of the kind holds for a matched text."""
    if kind == "ip":
        return F.forall(F.split(text, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.regexp_replace(text, "[\\x20-]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        plain = F.replace(text, F.lit(" "), F.lit(""))
        turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
        rest = F.aggregate(
            F.filter(F.split(turned, ""), lambda c: c != ""),
            F.lit(0),
            lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
        )
        return rest == 1
    return F.lit(True)


def detect(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out` (in place of a column of that name): array of (start, rank, end, kind, text, score, base), by start and kind.

    Confirmed candidates of the base kinds always stay. Candidates of the other kinds stay with a score of at least LEAST, where
    they don't overlap a base span.
    """
    work = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for k, (pattern, test) in KINDS.items():
        some = F.contains("_text", F.lit(test)) if test == "@" else F.col("_text").rlike(test)
        work = work.withColumn(f"_h_{k}", F.when(some, columns.matches(F.col("_text"), pattern)).otherwise(F.array().cast("array<string>")))
    nothing = F.array().cast("array<struct<text: string, before: string, step: int>>")
    work = work.withColumns({f"_z_{k}": F.when(F.size(f"_h_{k}") > 0, columns.found(F.col("_text"), F.col(f"_h_{k}"), p, NEAR)).otherwise(nothing) for k, (p, _) in KINDS.items()})
    work = work.withColumns({f"_e_{k}": columns.running_sums(F.transform(f"_z_{k}", lambda z: z["step"])) for k in KINDS})

    def scored(kind: str) -> Column:
        def span(z: Column, end: Column) -> Column:
            score = F.lit(SCORES[kind]) + F.when(F.lower(z["before"]).rlike(WORDS[kind]), CONTEXT).otherwise(0.0)
            return F.struct((end - F.length(z["text"])).alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), z["text"].alias("text"), F.round(score, 2).alias("score"), F.lit(kind in BASE).alias("base"))

        return F.filter(F.zip_with(f"_z_{kind}", f"_e_{kind}", span), lambda s: confirmed(kind, s["text"]) & (F.lit(kind in BASE) | (s["score"] >= LEAST)))

    work = work.select("_row", *(scored(k).alias(f"_p_{k}") for k in KINDS))
    work = work.select("_row", F.concat(*(F.col(f"_p_{k}") for k in BASE)).alias("_base"), F.concat(*(F.col(f"_p_{k}") for k in KINDS if k not in BASE)).alias("_more"))
    work = work.withColumn("_all", F.array_sort(F.concat("_base", "_more")))
    # An added span is free where no base span that begins earlier reaches it and none begins inside it.
    reach = columns.running(F.transform("_all", lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest)
    ahead = F.reverse(columns.running(F.reverse(F.transform("_all", lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))), F.least))
    room = F.zip_with(reach, ahead, lambda a, b: F.struct(a.alias("after"), b.alias("until")))
    both = F.zip_with("_all", room, lambda s, r: F.struct(s.alias("span"), (s["base"] | ((s["start"] >= r["after"]) & (s["end"] <= r["until"]))).alias("free")))
    free = F.transform(F.filter(both, lambda x: x["free"]), lambda x: x["span"])
    spans = F.when((F.size("_more") > 0) & (F.size("_base") > 0), free).otherwise(F.col("_all"))
    return work.withColumn(out, spans).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c != out), out)


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span in the text column replaced by its kind in brackets; of overlapping ones, the first names the gap.

    Same columns, same rows. Null texts stay null. Texts with spans are cut in a form of four bytes a character, where places are
    offsets, and put together once.
    """
    found = detect(docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_whole")), "_whole", "_pii")
    some = F.size("_pii") > 0
    work = found.select("_doc", "_whole", "_pii", F.when(some, columns.running(F.transform("_pii", lambda s: s["end"]), F.greatest)).alias("_reach"))

    def joined(wide: Column) -> Column:  # a variable of an outer function, as a column of the row would be copied for each piece
        cut = lambda a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")

        def piece(s: Column, at: Column) -> Column:  # what lies before a span, and its mark; after the last one, the rest
            marked = F.concat(cut(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s.isNull(), cut(at, F.length("_whole"))).when(s["start"] >= at, marked).otherwise("")

        return F.array_join(F.zip_with("_pii", F.concat(F.array(F.lit(0)), "_reach"), piece), "")

    new = F.when(some, F.get(F.transform(F.array(F.encode("_whole", "UTF-32")), joined), F.lit(0))).otherwise(F.col("_whole"))
    done = work.withColumn("_new", new)
    return done.select(*((F.col("_new") if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(dealt_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


QUERIES = {"op2_personal_data": op2_personal_data}
SQL: dict[str, str] = {}
