"""Secret scans with DataFrame functions only.

Base kinds are three regular expressions. The method adds tokens whose characters look
drawn at random: two first-order Markov chains over ASCII characters, of random strings
and of ordinary identifiers, are trained from labelled samples; a token of LEAST_TOKEN
characters or more, apart from base spans, is a span of kind ``random`` when its mean log
likelihood ratio per character is at least THRESHOLD.

Labelled samples: base matches of at most SAMPLE_DOCS documents (chosen by a hash of the
id) and SAMPLE_RANDOM encoded digests are random strings; the other tokens of those
documents, and names made of neighbouring ones, are ordinary.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.common import text_or_empty

#: The base kinds in order, their patterns and the words that an assignment starts with.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_WORDS = ["passw", "secret", "token", "api"]
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "random"]

#: A run of token characters; shorter ones are never taken for secrets.
LEAST_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
THRESHOLD = 1.5
SAMPLE_DOCS = 2_000
SAMPLE_RANDOM = 5_000
#: Added to each character's count, and the weight of single characters against pairs.
SMOOTHING, BACKOFF = 0.5, 5.0
_SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def _before(values: Column, combine, first: int) -> Column:
    """For each number of an array what ``combine`` makes of ``first`` and all numbers before it, and, last, of all.

    The array is cut into about as many parts as each has numbers: arrays that grow (and are
    copied) in a fold hold one part's results, so that time grows with n ** 1.5, not n ** 2.
    """
    fold = lambda part, start: F.aggregate(part, start, combine)
    nothing = F.array().cast("array<int>")

    def scan(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])

    def of_parts(parts: Column) -> Column:
        starts = scan(F.transform(parts, lambda part: fold(part, F.lit(first))), F.lit(first))
        return let(starts, lambda s: F.flatten(F.transform(parts, lambda part, k: scan(part, F.get(s, k)))))

    def whole(values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(values))).cast("int")
        parts = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")), lambda k: F.slice(values, k * n + 1, n)))
        return F.when(F.size(values) > 0, F.array_append(let(parts, of_parts), fold(values, F.lit(first)))).otherwise(F.array(F.lit(first)))

    return let(values, whole)


def _runs(gaps: Column, found: Column, kind: int) -> Column:
    """Spans of all matches, from the matches and the text between them."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, match: F.length(gap) + F.length(match))
    span = lambda starts, match, k: F.struct((F.get(starts, k + 1) - F.length(match)).alias("start"), F.lit(kind).alias("kind"), F.get(starts, k + 1).alias("end"), match.alias("match"))
    return let(_before(lengths, lambda x, y: x + y, 0), lambda starts: F.transform(found, lambda match, k: span(starts, match, k)))


def _with_runs(df: DataFrame, name: str, pattern: str, kind: int, where: Column | None = None) -> DataFrame:
    """``df`` with the spans of a pattern; ``where`` says which texts can hold it at all."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn("_found", found if where is None else F.when(where, found).otherwise(none))
    gaps = F.split("text", pattern, -1)
    return df.withColumn(name, F.when(F.size("_found") > 0, _runs(gaps, F.col("_found"), kind)).otherwise(F.array().cast(_SPAN))).drop("_found")


def _with_base(df: DataFrame) -> DataFrame:
    low = F.lower("text")
    hint = low.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        hint |= low.contains(word)
    df = _with_runs(df, "_assign", ASSIGN, 0, hint)
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= LEAST_VALUE))
    df = _with_runs(df, "_access", ACCESS, 1, F.col("text").contains("AKIA"))
    return _with_runs(df, "_hex", HEX, 2)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log likelihood ratios of character pairs, 128 x 128 in a row: how much likelier the second follows the first in random strings."""
    spark = docs.sparkSession
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    chosen = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) < F.lit(int(share * (1 << 30)))
    sample = _with_base(_texts(docs, id_col, text_col).filter(chosen))
    values = F.concat(F.transform("_assign", lambda x: F.regexp_extract(x["match"], ASSIGN, 2)), F.transform("_access", lambda x: x["match"]), F.transform("_hex", lambda x: x["match"]))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    sample = sample.select(values.alias("random"), F.regexp_extract_all(rest, F.lit(TOKEN % 4), F.lit(0)).alias("ordinary"))
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    made = spark.range(SAMPLE_RANDOM).select(F.regexp_replace(F.base64(digest), "=", "").alias("word"))
    # names as programs have them, of neighbouring words
    shapes = lambda a, b: F.array(F.concat(F.lower(a), F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("_", F.lower(a), F.lower(b)), F.concat_ws("_", F.upper(a), F.upper(b)), F.concat_ws("/", a, b), F.concat_ws("-", a, b))
    names = F.flatten(F.zip_with("ordinary", F.slice("ordinary", 2, F.size("ordinary")), lambda a, b: F.when(b.isNotNull(), shapes(a, b)).otherwise(F.array(a))))
    words = (sample.select(F.explode("random").alias("word")).unionByName(made).withColumn("random", F.lit(True))
             .unionByName(sample.select(F.explode(F.concat("ordinary", names)).alias("word")).withColumn("random", F.lit(False))))
    words = words.groupBy("random", "word").agg(F.count("*").alias("n")).filter(F.length("word") > 1)
    pairs = words.select("random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("pair"))
    counted = pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()  # of 2 * 65**2 kinds at most
    pair, first, second, total = (defaultdict(int) for _ in range(4))
    for r in counted:
        kind, (a, b) = r["random"], r["pair"]
        for table, key in ((pair, (kind, a, b)), (first, (kind, a)), (second, (kind, b)), (total, kind)):
            table[key] += r["n"]

    def logp(random: bool, a: str, b: str) -> float:
        alone = (second[random, b] + SMOOTHING) / (total[random] + SMOOTHING * 65)
        return math.log((pair[random, a, b] + BACKOFF * alone) / (first[random, a] + BACKOFF))

    chars = [chr(c) for c in range(128)]
    return [logp(True, a, b) - logp(False, a, b) for a in chars for b in chars]


def _mean_ratio(token: Column, table: Column) -> Column:
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    steps = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: F.get(table, a * 128 + b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) / (F.length(token) - 1)


def _overlapping(spans: Column) -> Column:
    """For each of some spans in order whether it meets a base span: one that starts no later and ends behind its start, or one after it that starts before its end."""
    far = 2**31 - 1
    ends = F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0)))
    starts = F.transform(F.reverse(spans), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(far)))
    before, behind = _before(ends, lambda x, y: F.greatest(x, y), 0), _before(starts, lambda x, y: F.least(x, y), far)
    n = F.size(spans)
    return let(before, lambda b: let(behind, lambda a: F.transform(spans, lambda x, k: (F.get(b, k) > x["start"]) | (F.get(a, n - 1 - k) < x["end"]))))


def find(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep`` and ``found``, an array of (start, kind, end, match).

    Ordered by start, then by kind (an index of KINDS); code points, end exclusive. Null and
    empty texts have none. Repeated rows get equal rows.
    """
    extra = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    df = docs.select(F.col(f"`{id_col}`").alias("id"), *extra, text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    df = _with_runs(_with_base(df), "_token", TOKEN % LEAST_TOKEN, 3)
    df = df.withColumn("_all", F.array_sort(F.concat("_assign", "_access", "_hex", "_token")))
    table = F.expr("array(" + ",".join(f"{x:.6f}D" for x in model) + ")")
    random = lambda x, apart: apart & (_mean_ratio(x["match"], table) >= THRESHOLD)
    kept = let(_overlapping(F.col("_all")), lambda hit: F.filter("_all", lambda x, k: (x["kind"] < 3) | random(x, ~F.get(hit, k))))
    return df.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.when(F.size("_token") > 0, kept).otherwise(F.col("_all")).alias("found"))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``.

    Pieces are cut from a form of four bytes a character, so that no cut walks through the text.
    """
    def pieces(wide: Column) -> Column:
        part = lambda start, end: F.decode(F.substring(wide, start * 4 + 1, (end - start) * 4), "UTF-32")
        piece = lambda x, at: F.when(x["start"] >= at, F.concat(part(at, x["start"]), F.lit(mark))).otherwise(F.lit(""))
        joined = lambda at: F.concat(F.array_join(F.transform(found, lambda x, k: piece(x, F.get(at, k))), ""), part(F.get(at, F.size(found)), F.length(text)))
        return let(_before(F.transform(found, lambda x: x["end"]), lambda x, y: F.greatest(x, y), 0), joined)

    return F.when(F.size(found) > 0, let(F.encode(text, "UTF-32"), pieces)).otherwise(text)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find``'s spans."""
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select(id_col, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
