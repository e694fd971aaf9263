"""Secret scans with Spark's own functions only.

Patterns give the base spans. Two Markov models of neighbouring characters, of random strings and of ordinary words,
are trained from labelled samples: values of base spans against words of the corpus. A further run of token characters, cut
where a base span begins or ends, is a secret if its log-likelihood ratio is high enough. All work on rows is in DataFrame
functions; the driver holds the two tables of character pairs, whose size is that of the alphabet squared.

Lists of spans and redacted texts are put together in blocks, so that a long text with many secrets is not copied for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import least_hashed, stored

# What the base patterns are.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A base span, or as the third group a run of 16 token characters or more that begins where a run does or a base span ends.
TOKEN = rf"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{{12,}})|{ACCESS}|{HEX}|(?:\G|(?<![A-Za-z0-9+/_=-]))(?=[A-Za-z0-9+/_=-]{{16}})((?:(?!(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{12}}|{ACCESS}|{HEX})[A-Za-z0-9+/_=-]){{16,}}+)"""
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{5,}+"

#: Documents whose words, and distinct values that, train the models at most: those of the smallest hashes.
WORD_DOCUMENTS, VALUES = 1000, 5000
#: The texts that must have a word for it to be ordinary.
WORD_TEXTS = 2
#: How often each character counts as seen beside itself in ordinary words: rules and filling are runs of one character.
RUNS = 5
#: Added to each character's count; the weight of the characters' own chances beside the counts of pairs.
SMOOTHING, BACK_OFF = 0.5, 2.0
#: The least ratio of a secret, in all and for each pair of characters, and the most that one pair can say (natural logarithm).
LEAST_RATIO, LEAST_MEAN, MOST = 20.0, 1.0, 4.0

#: Matches, and characters of a text, that are worked on together.
BLOCK, TEXT_BLOCK = 256, 4096

NONE = "array<struct<start:int,kind:int,end:int>>"


def placed(text: Column, pattern: str, kind: int, group: int, fields: str, value: Callable[[Column], dict[str, Column]]) -> Column:
    """An array of (start, kind, end, ... of `value`) of the leftmost non-overlapping matches for which value's "kept" is true, in code
    points. `value` is given the match's `group`; `fields` are the types of what it adds."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(F.transform(parts, F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("said"))  # one more gap than matches
    none = F.array().cast(f"array<struct<start:int,kind:int,end:int{fields}>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        more = value(x["said"])
        kept = more.pop("kept")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *[c.alias(n) for n, c in more.items()])
        return F.struct(end.alias("at"), F.when(x["size"].isNotNull() & kept, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def moved(x: Column, by: Column) -> Column:
        return F.transform(x, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), *[s[n].alias(n) for n in value(F.lit("")) if n != "kept"]))

    def summed(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, BLOCK), begin, step))

    blocks = F.transform(F.array(each), summed)[0]  # the matches are found once, not for each block
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<start:int,kind:int,end:int{fields}>>>").alias("out"))
    whole = F.aggregate(blocks, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], moved(x["out"], acc["at"])).alias("out")), lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), whole).otherwise(none)


def spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans (start, kind, end) of the matches; with `least`, of those whose second group has so many characters."""
    return placed(text, pattern, kind, 2 if least else 0, "", lambda x: {"kept": F.length(x) >= least})


def base_spans(text: Column) -> Column:
    return F.concat(spans(text, ASSIGN, 0, 12), spans(text, ACCESS, 1), spans(text, HEX, 2))


def pair_counts(tokens: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring characters occurs in `tokens` (token): at most the alphabet squared. In time linear in a token."""
    signs = tokens.where(F.length("token") > 1).select(F.split("token", "").alias("signs"))
    pairs = F.zip_with(F.slice("signs", 1, F.size("signs") - 1), F.slice("signs", 2, F.size("signs") - 1), lambda a, b: F.concat(a, b))
    return {r["pair"]: r["count"] for r in signs.select(F.explode(pairs).alias("pair")).groupBy("pair").count().collect()}


def log_chances(counts: dict[str, int]) -> dict[str, float]:
    """Log-probability of the second character of each pair, given the first; pairs not seen fall back on how common the second is."""
    total = sum(counts.values())
    common = {b: (sum(counts.get(a + b, 0) for a in ALPHABET) + SMOOTHING) / (total + SMOOTHING * len(ALPHABET)) for b in ALPHABET}
    out = {}
    for a in ALPHABET:
        row = sum(counts.get(a + b, 0) for b in ALPHABET)
        for b in ALPHABET:
            out[a + b] = math.log((counts.get(a + b, 0) + BACK_OFF * common[b]) / (row + BACK_OFF))
    return out


def trained(docs: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random strings over ordinary words, row by row of the alphabet.

    Random strings are the values of base spans of all of `docs`, at most VALUES different ones; a corpus without any
    leaves them even over letters and digits. Words are those of WORD_DOCUMENTS documents, outside of base spans, that stand
    in WORD_TEXTS different texts or more: a random string stands in one, and must not count as a word.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(text.alias("text")).where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    value = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    values = least_hashed(stored(found.select(F.explode(value).alias("token")).where(F.length("token") >= 12).distinct(), "values"), VALUES, "token")
    some = least_hashed(docs.select("doc_id", text.alias("text")), WORD_DOCUMENTS, "doc_id", "text").select("text")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    each = some.distinct().select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)))).alias("token"))
    shared = each.groupBy("token").count().where(F.col("count") >= WORD_TEXTS)
    words = shared.select(F.explode(F.array_repeat("token", F.col("count").cast("int"))).alias("token"))  # as often as texts have it
    even = {a + b: 1 for a in ALPHABET[:62] for b in ALPHABET[:62]}
    secret, ordinary = pair_counts(values), pair_counts(words)
    random = log_chances({k: 2 * even.get(k, 0) + secret.get(k, 0) for k in even.keys() | secret.keys()})
    word = log_chances(ordinary | {a + a: ordinary.get(a + a, 0) + RUNS for a in ALPHABET})
    return [max(-MOST, min(MOST, random[a + b] - word[a + b])) for a in ALPHABET for b in ALPHABET]


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token: the sum over its pairs of characters."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded into one constant
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, c: F.struct(
        c.alias("before"),
        (acc["sum"] + F.when((acc["before"] > 0) & (c > 0), F.element_at(ratios, ((acc["before"] - 1) * len(ALPHABET) + c).cast("int"))).otherwise(0.0)).alias("sum"),
    )
    return F.aggregate(place, F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def markov_spans(text: Column, table: list[float]) -> Column:
    """Spans of token characters that touch no base span and that the models take for random."""
    found = placed(text, TOKEN, 3, 3, ",token:string", lambda x: {"kept": F.length(x) >= 16, "token": x})

    def random(s: Column) -> Column:
        total = ratio(s["token"], table)
        return (total >= LEAST_RATIO) & (total >= LEAST_MEAN * (s["end"] - s["start"] - 1))

    return F.transform(F.filter(found, random), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def with_secrets(docs: DataFrame) -> DataFrame:
    """Every row of `docs` (doc_id, text, any others) with `_base` and `_spans`: base spans and all spans, by start, then kind.

    A null text is empty and has none. The models are trained on `docs` itself.
    """
    table = trained(docs)
    text = F.coalesce("text", F.lit(""))
    return (
        docs.withColumn("_base", F.array_sort(base_spans(text)))
        .withColumn("_spans", F.array_sort(F.concat("_base", markov_spans(text, table))))
    )


def said(found: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of `docs` (doc_id, text). Repeated rows stay."""
    found = with_secrets(docs.select("doc_id", "text"))
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size("_base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(said(F.col("_base")), 256).alias("base_sha256"), said(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret in `text` replaced by `mark`; overlapping spans are one. Other rows and columns stay as they are."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def hidden(part: Column, i: Column) -> Column:
        first = i * TEXT_BLOCK
        near = F.filter("_spans", lambda s: (s["end"] > first) & (s["start"] < first + TEXT_BLOCK))
        between = lambda a, b: F.substring(part, a - first + 1, F.greatest(b - a, F.lit(0)))

        def step(acc: Column, s: Column) -> Column:
            more = F.when(s["start"] >= acc["at"], F.concat(between(acc["at"], s["start"]), F.lit(mark))).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

        return F.aggregate(near, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], between(acc["at"], first + TEXT_BLOCK)))

    whole = F.concat_ws("", F.transform(parts, hidden))
    return with_secrets(docs).withColumn("text", F.when(F.size("_spans") > 0, whole).otherwise(F.col("text"))).drop("_base", "_spans")
