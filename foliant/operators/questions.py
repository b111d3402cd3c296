"""Question building, quality filters and near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists
from ..functions import text as T
from ..functions.policy import is_blocked
from ..plans.scans import top_rows
from ..session import cut, stored

MIN_QUESTION_CHUNK = 180
SAME_QUESTION = 0.82
RECENT = 8


# -- predicates -------------------------------------------------------------------------

def is_low_precision(question) -> Column:
    def judge(n):
        padded = F.concat(F.lit(" "), n, F.lit(" "))
        bare = n.rlike(r"^what did (?:(?:mr|mrs|ms|miss|dr) )?[a-z]+(?: [a-z]+)? (?:say|ask|reply|return|cry|shout|whisper)$")
        vague = T.any_of(padded, [f" {w} " for w in lists.VAGUE_SUBJECTS]) | (
            n.startswith("what did the ") & T.any_of(padded, [f" {w} " for w in lists.VAGUE_OBJECTS]))
        return (n == "") | bare | vague | n.rlike(" (?:to|for|with|about)$") | T.any_of(n, lists.VAGUE_PHRASES)
    return T.let(T.question_norm(question), judge)


def is_low_quality_answer(question, answer) -> Column:
    a = T.col(answer)
    n = T.question_norm(a)
    marks = F.regexp_count(F.regexp_replace(a, r"(?iU)\b(Mr|Mrs|Ms|Dr|Miss)\.", "$1"), F.lit("[.?!]"))
    return ((n == "") | (F.size(F.split(n, " ")) < 4) | (F.length(a) > 200) | (marks > 1)
            | F.lower(a).rlike("^(?:and|but|or|so|then) ") | (T.question_norm(question) == n))


def has_pronoun_lead(question) -> Column:
    return T.strip(F.lower(T.col(question))).rlike("^(?:" + "|".join(lists.PRONOUN_LEADS) + ")")


def restates(question, answer, limit: float = 0.72) -> Column:
    words = lambda x: T.word_set(T.question_norm(x))
    return T.jaccard(words(question), words(answer)) >= limit


def eligible_chunks(chunks: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Safe chunks long enough for a question; all safe chunks where none is long enough."""
    safe = stored(is_blocked(chunks, "content", "retrieved_context", "_b").filter("not _b").drop("_b").withColumn(
        "_long", F.length(T.strip("content")) >= MIN_QUESTION_CHUNK))  # judged once, read twice
    some = safe.groupBy(dataset).agg(F.max("_long").alias("_some"))
    return safe.join(some, dataset).filter(F.col("_long") | ~F.col("_some")).drop("_long", "_some")


def shuffled(chunks: DataFrame, seed: int = 0) -> DataFrame:
    """Repeatable random order."""
    return chunks.orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id")


# -- speech questions ------------------------------------------------------------------------

_SPOKEN = r'["“]([^"”]{6,180})["”]'
_CUE = r"(asked|cried|shouted|whispered)\s+(" + lists.SPEAKER + r"),\s*([^,\"“”]{4,80}),\s*" + _SPOKEN
_LEAD_CUE = r'["“][^"”]{2,80}["”],\s*' + _CUE
_REPLY = (r'["“]([^"”]{3,120})["”]\s*(replied|returned|said)\s+(' + lists.SPEAKER + r')(?:,\s*["“]([^"”]{3,180})["”])?')


def _trim(x) -> Column:
    return T.squeeze(T.strip_chars(x, " ,;:-"))


def cue_phrase(cue) -> Column:
    """When-clause made of the words around a quote; empty when they do not tell a moment."""
    c = T.squeeze(cue)
    w = F.split(T.question_norm(c), " ")
    first = F.get(w, F.lit(0))
    return (F.when(F.size(w) < 2, "").when(first.isin("while", "when", "after", "before", "during", "upon", "as"), F.lower(c))
            .when(first.isin("with", "without", "in", "on", "at", "under") | F.exists(w, lambda x: x.endswith("ing")),
                  F.concat(F.lit("while "), F.lower(c))).otherwise(""))


def quote_for_question(quote) -> Column:
    c = T.squeeze(quote)
    w = F.split(c, " ")
    cut_text = F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, 14), " "), r"[ ,;:\-]+$", ""), F.lit("..."))
    return F.when((F.size(w) <= 14) & (F.length(c) <= 90), c).otherwise(cut_text)


def speech_questions(chunks: DataFrame) -> DataFrame:
    """Question and model answer from a passage in which someone speaks; chunks without one drop out."""
    rows = chunks.withColumn("_t", T.squeeze("content")).filter(F.col("_t").rlike('["“”]'))
    part = lambda pattern, i: F.regexp_extract("_t", "(?U)" + pattern, i)
    base = F.from_json(F.lit("{" + ", ".join(f'"{k}": "{v}"' for k, v in lists.SPEECH_BASE.items()) + "}"), "map<string,string>")

    def cued(pattern):
        speaker, verb, cue, quote = _trim(part(pattern, 2)), part(pattern, 1), cue_phrase(_trim(part(pattern, 3))), _trim(part(pattern, 4))
        return F.when((speaker != "") & (quote != "") & (cue != ""), F.struct(
            F.concat(F.lit("What did "), speaker, F.lit(" "), F.try_element_at(base, verb), F.lit(" "), cue, F.lit("?")).alias("question"),
            F.concat(speaker, F.lit(" "), verb, F.lit(', "'), quote, F.lit('"')).alias("model_answer")))

    reply = "(?U)" + _REPLY
    # the text of the match first occurs where the match starts
    before = F.substr("_t", F.lit(1), F.position(F.regexp_extract("_t", reply, 0), F.col("_t")) - 1)
    earlier = F.regexp_extract_all(before, F.lit(_SPOKEN), F.lit(1))
    heard = quote_for_question(F.element_at(earlier, -1))
    speaker = _trim(F.regexp_extract("_t", reply, 3))
    verb = F.regexp_extract("_t", reply, 2)
    spoken = T.squeeze(F.concat_ws(" ", _trim(F.regexp_extract("_t", reply, 1)), _trim(F.regexp_extract("_t", reply, 4))))
    replied = F.when((F.size(earlier) > 0) & (speaker != "") & (spoken != "") & (heard != ""), F.struct(
        F.concat(F.lit("What did "), speaker, F.lit(' say after hearing "'), heard, F.lit('"?')).alias("question"),
        F.concat(speaker, F.lit(" "), verb, F.lit(', "'), spoken, F.lit('"')).alias("model_answer")))
    rows = rows.withColumn("_q", F.coalesce(cued(_CUE), cued(_LEAD_CUE), replied)).filter("_q is not null")
    return rows.select(*chunks.columns, "_q.question", "_q.model_answer")


# -- near duplicates -----------------------------------------------------------------------------

def _token_sets(questions: DataFrame, keys: list[str], question: str) -> DataFrame:
    return questions.select(*keys, T.question_norm(question).alias("normalized")).filter("normalized <> ''").withColumn(
        "tokens", F.array_sort(T.word_set("normalized")))


def _prefixes(sets: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """The rarest tokens of each set with their places: two sets as similar as ``least`` must share one of them."""
    # a set's tokens meet their counts one row each, without the set: a row with all of it would carry it once per token
    ranked = sets.select("dataset_id", "id", F.explode("tokens").alias("token")).join(frequency.hint("merge"), ["dataset_id", "token"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    whole = ranked.groupBy("dataset_id", "id").agg(order.alias("by_rarity"))
    size = F.size("by_rarity")
    keep = size - F.ceil(size * least - 1e-9).cast("int") + 1
    return whole.select("dataset_id", "id", size.alias("size"), F.posexplode(F.slice("by_rarity", F.lit(1), keep)).alias("place", "token"))


def similar_sets(left: DataFrame, right: DataFrame, least: float = SAME_QUESTION) -> DataFrame:
    """Pairs (dataset_id, l_id, r_id, similarity) of token sets at least ``least`` alike.

    Both sides: dataset_id, id, tokens, with one row per distinct set, so copies
    never meet each other. Candidates share a rare prefix token, fit in size, and have enough tokens
    left from there on; only they get their sets. The joins are merges: their sides are narrow and compress well,
    so that by the size of a shuffle they would be broadcast, and grow on the driver.
    """
    every = left.select("dataset_id", "tokens") if left is right else left.select("dataset_id", "tokens").unionByName(right.select("dataset_id", "tokens"))
    frequency = every.select("dataset_id", F.explode("tokens").alias("token")).groupBy("dataset_id", "token").agg(F.count("*").alias("n"))
    own = cut(_prefixes(left, frequency, least))
    other = own if left is right else cut(_prefixes(right, frequency, least))
    side = lambda df, p: df.select("dataset_id", "token", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "size", "place")])
    fits = (F.col("l_size") >= F.col("r_size") * least - 1e-9) & (F.col("r_size") >= F.col("l_size") * least - 1e-9)
    # the first token two sets share has all others they share behind it
    rest = F.least(F.col("l_size") - F.col("l_place"), F.col("r_size") - F.col("r_place"))
    enough = rest >= (F.col("l_size") + F.col("r_size")) * (least / (1 + least)) - 1e-9
    met = side(own, "l").join(side(other, "r").hint("merge"), ["dataset_id", "token"]).filter(fits & enough).select("dataset_id", "l_id", "r_id").distinct()
    of = lambda df, p: df.select("dataset_id", F.col("id").alias(f"{p}_id"), F.col("tokens").alias(f"{p}_tokens")).hint("merge")
    both = met.join(of(left, "l"), ["dataset_id", "l_id"]).join(of(right, "r"), ["dataset_id", "r_id"])
    return both.select("dataset_id", "l_id", "r_id", T.jaccard("l_tokens", "r_tokens").alias("similarity")).filter(F.col("similarity") >= least - 1e-12)


def not_asked_before(candidates: DataFrame, history: DataFrame, question: str = "question") -> DataFrame:
    """Candidates unlike every question of the history of their dataset."""
    digest = F.unhex(F.sha2(F.array_join("tokens", " "), 256))
    new = cut(_token_sets(candidates, ["dataset_id", "question_id"], question).withColumn("id", digest))
    old = _token_sets(history, ["dataset_id"], question).withColumn("id", digest)
    sets = lambda df: cut(df.groupBy("dataset_id", "id").agg(F.any_value("tokens").alias("tokens")))
    known = similar_sets(sets(new), sets(old)).select("dataset_id", F.col("l_id").alias("id")).distinct()
    stale = new.select("dataset_id", "question_id", "id").join(known.hint("merge"), ["dataset_id", "id"]).select("dataset_id", "question_id")
    return candidates.join(stale.hint("merge"), ["dataset_id", "question_id"], "left_anti")


def keep_first(candidates: DataFrame, order: str = "seq", question: str = "question") -> DataFrame:
    """Accept in order, reject what resembles an accepted one: the sequential result, in rounds.

    A set with no earlier undecided neighbor is kept, its neighbors are dropped,
    until none is undecided. Copies collapse to their first row beforehand.
    """
    rows = _token_sets(candidates, ["dataset_id", order], question)
    first = cut(rows.groupBy("dataset_id", "tokens").agg(F.min(order).alias("id")))
    edges = cut(similar_sets(first, first).filter("l_id < r_id").select("dataset_id", F.col("l_id").alias("early"), F.col("r_id").alias("late")))
    undecided, kept = first.select("dataset_id", "id"), None
    while True:
        blocked = edges.select("dataset_id", F.col("late").alias("id")).distinct()
        winners = cut(undecided.join(blocked.hint("merge"), ["dataset_id", "id"], "left_anti"))
        kept = winners if kept is None else kept.unionByName(winners)
        lost = edges.join(winners.withColumnRenamed("id", "early").hint("merge"), ["dataset_id", "early"]).select(
            "dataset_id", F.col("late").alias("id")).distinct()
        decided = winners.unionByName(lost)
        undecided = cut(undecided.join(decided.hint("merge"), ["dataset_id", "id"], "left_anti"))
        if not undecided.head(1):
            break
        edges = cut(edges.join(undecided.withColumnRenamed("id", "early").hint("merge"), ["dataset_id", "early"], "left_semi").join(
            undecided.withColumnRenamed("id", "late").hint("merge"), ["dataset_id", "late"], "left_semi"))
    return candidates.join(kept.withColumnRenamed("id", order).hint("merge"), ["dataset_id", order], "left_semi")


def recent_questions(history: DataFrame, limit: int = RECENT, order: str = "seq") -> DataFrame:
    return top_rows(history.filter(T.question_norm("question") != ""), ["dataset_id"], [F.desc(order)], limit, "age")


def pruned(history: DataFrame, remove: Column) -> DataFrame:
    """History without the rows a predicate names."""
    return history.filter(~remove)


def generate_questions(chunks: DataFrame, history: DataFrame | None = None, candidates: DataFrame | None = None,
                       dataset: str = "dataset_id", seed: int = 0) -> DataFrame:
    """Fresh, self-contained questions with their evidence ids.

    ``candidates`` (dataset_id, chunk_id, source_name, question, model_answer) made
    by a model go through the stricter filters and join the rule-built ones.
    """
    ready = eligible_chunks(chunks, dataset)
    # written once: the filters below look at question and answer many times over
    made = cut(speech_questions(ready).select(dataset, "chunk_id", "source_name", "question", "model_answer"))
    if candidates is not None:
        extra = candidates.select(dataset, "chunk_id", "source_name", T.squeeze("question").alias("question"),
                                  T.squeeze("model_answer").alias("model_answer"))
        extra = extra.filter((F.size(F.split(T.question_norm("question"), " ")) >= 5) & (T.question_norm("model_answer") != "")
                             & ~restates("question", "model_answer") & ~has_pronoun_lead("question"))
        made = made.unionByName(extra)
    made = made.filter(~is_low_precision("question") & ~is_low_quality_answer("question", "model_answer"))
    made = is_blocked(made.withColumn("_both", F.concat_ws("\n", "question", "model_answer")), "_both", "generated_content", "_b").filter(
        "not _b").drop("_b", "_both")
    made = made.withColumn("seq", F.xxhash64(F.lit(seed), dataset, "chunk_id", "question"))
    made = cut(made.withColumn("question_id", F.substring(F.sha2(F.concat_ws("|", dataset, "chunk_id", "question"), 256), 1, 12)))
    if history is not None:
        kept = pruned(history, is_low_precision("question"))
        made = not_asked_before(made, kept)
    return keep_first(made).select("question_id", dataset, "question", "model_answer", F.array("source_name").alias("source_names"),
                                   F.array("chunk_id").alias("source_chunk_ids"))
