"""Chat history: safe turns, selection under a size budget, prompts, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T
from ..functions.responses import TRUNCATION_REASONS, truncation_reason
from ..functions.policy import is_refusal, policy_decision, refusal_message, with_policy
from ..plans.scans import dense_index, preceding_rows, running_sum, top_rows

HISTORY_MESSAGES = 20
HISTORY_TURNS = 3
HISTORY_CHARS = 4200
RECALL_CHARS = 520
FILE_CHARS = 2200
ALL_FILES_CHARS = 3200
NUM_CTX, MAX_ANSWER, CONTINUATIONS = 6144, 3072, 8
VISION_CTX, VISION_ANSWER, VISION_CONTINUATIONS = 3072, 1280, 2
MIN_PREDICT = 192
ATTACHMENT = "struct<name:string,kind:string,storage_path:string,text_path:string,text_excerpt:string>"


# -- history rows ------------------------------------------------------------------------

def flag(payload: Column, key: str) -> Column:
    """A payload flag counts as set unless it is missing, false, zero or empty."""
    value = F.get_json_object(payload, f"$.{key}")
    return F.coalesce(~value.isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


def mark_safe(messages: DataFrame, content: str = "content") -> DataFrame:
    """Add ``safe``: whether a message may be used as history."""
    payload = F.col("payload") if "payload" in messages.columns else F.lit(None).cast("string")
    role = F.lower(T.strip("role"))
    blocked = lambda purpose: policy_decision(content, purpose)["blocked"]  # decided for the message's own role only
    user_ok = ~blocked("user_query") & ~F.coalesce(F.get_json_object(payload, "$.blocked_stage") == "user_query", F.lit(False))
    assistant_ok = ~blocked("model_output") & ~is_refusal(content) & ~flag(payload, "safety_refusal")
    safe = ~T.is_blank(F.coalesce(content, F.lit(""))) & ~flag(payload, "exclude_from_history") & (
        F.when(role == "user", user_ok).when(role == "assistant", assistant_ok).otherwise(False))
    return messages.withColumn("safe", safe)


def turn_numbers(messages: DataFrame, conv: str = "conv_id", order: str = "turn", block: int = 8192) -> DataFrame:
    """User messages open a turn, assistant messages join it; leading assistant messages are turn 0."""
    kept = messages.filter(F.col("role").isin("user", "assistant"))
    return running_sum(kept, [conv], order, F.when(F.col("role") == "user", 1).otherwise(0), "turn_no", block)


def budgeted_tail(messages: DataFrame, size: Column, budget: int = HISTORY_CHARS, conv: str = "conv_id",
                  order: str = "turn", block: int = 8192) -> DataFrame:
    """Newest messages whose running size fits the budget; the newest always stays."""
    newest = messages.groupBy(conv).agg(F.max(order).alias("_newest"))
    sized = running_sum(messages.withColumn("_size", size), [conv], order, F.col("_size"), "running", block, newest_first=True)
    return sized.join(newest, conv).filter((F.col("running") <= budget) | (F.col(order) == F.col("_newest"))).drop(
        "_size", "_newest")


def last_messages(messages: DataFrame, limit: int = HISTORY_MESSAGES, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    return top_rows(messages, [conv], [F.desc(order)], limit, "age")


def with_history(messages: DataFrame, conv: str = "conv_id", order: str = "turn", block: int = 8192) -> DataFrame:
    """Each message with its safe predecessors among the last twenty, oldest first."""
    rows = dense_index(mark_safe(messages), [conv], order, "position", block)
    names = F.col("names") if "names" in rows.columns else F.array().cast("array<string>")
    rows = rows.withColumn("names", names)
    rows = preceding_rows(rows, [conv], "position", ["role", "content", "names", "safe"], HISTORY_MESSAGES, "history", block)
    return rows.withColumn("history", F.filter("history", lambda m: m["safe"]))


# -- selection (row-local: a history holds at most twenty messages) -------------------------

def turns_of(history: Column) -> Column:
    empty = F.slice(F.array(history), 1, 0)
    return F.aggregate(history, empty, lambda acc, m: F.when(
        (m["role"] == "user") | (F.size(acc) == 0), F.array_append(acc, F.array(m))).otherwise(
        F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array_append(F.element_at(acc, -1), m))))


def turn_text(turn: Column) -> Column:
    return T.history_norm(F.array_join(F.transform(turn, lambda m: m["content"]), " "))


def is_memory_recall(norm) -> Column:
    n = T.col(norm)
    return (n.contains("remember") & T.any_of(n, lists.MEMORY_MARKERS)) | T.any_of(n, lists.MEMORY_PHRASES)


def is_follow_up(norm, latest_has_files) -> Column:
    n = T.col(norm)
    w = F.split(n, " ")
    refers = (F.size(w) <= 12) & F.arrays_overlap(w, T.words(lists.FOLLOW_UP_WORDS))
    files = latest_has_files & (F.size(w) <= 14) & T.any_of(n, lists.ATTACHMENT_FOLLOW_UPS)
    starts = n.rlike("^(?:" + "|".join(T.quote(p) for p in lists.FOLLOW_UP_PREFIXES) + ")")
    return (n != "") & (n.isin("continue", "go on", "more") | starts | refers | files)


def is_relevant(turn: Column, norm: Column, terms: Column) -> Column:
    """Whether a turn belongs to what the current message asks."""
    def judge(t):
        text, own = t["text"], t["terms"]
        same = (F.length(norm) >= 18) & (F.contains(text, norm) | F.contains(norm, text))
        story = (F.arrays_overlap(terms, T.words(lists.STORY_TERMS)) & F.arrays_overlap(terms, T.words(lists.STORY_FOLLOW_UPS))
                 & F.arrays_overlap(own, T.words(lists.STORY_TERMS)))

        def by_terms(shared):
            n = F.size(shared)
            lone = (n == 1) & (F.length(F.get(shared, F.lit(0))) >= 6) & ((F.size(terms) <= 4) | (F.size(own) <= 8))
            share = n / F.greatest(F.lit(1), F.least(F.size(terms), F.size(own)))
            return (n >= 2) | lone | ((share >= 0.5) & (n > 0))

        return F.when(text == "", False).when(same, True).when(F.size(own) == 0, False).otherwise(
            story | T.let(F.array_intersect(terms, own), by_terms))

    return T.let(turn_text(turn), lambda text: T.let(F.struct(text.alias("text"), T.history_terms(text).alias("terms")), judge))


def recall_turns(norm: Column, turns: Column) -> Column:
    """Turns for a question about the conversation itself."""
    with_user = F.filter(turns, lambda t: F.exists(t, lambda m: m["role"] == "user"))
    story = F.filter(turns, lambda t: F.arrays_overlap(T.history_terms(turn_text(t)), T.words(lists.STORY_TERMS)))
    first = (norm.contains("first question") | norm.contains("first thing")) & (F.size(with_user) > 0)
    asked_story = T.any_of(norm, lists.STORY_TERMS) & (F.size(story) > 0)
    asked = (norm.contains("what did i ask") | norm.contains("question")) & (F.size(with_user) > 0)
    return (F.when(first, F.slice(with_user, 1, 1)).when(asked_story, F.slice(story, -1, 1))
            .when(asked, F.slice(with_user, -1, 1)).otherwise(_last(turns, HISTORY_TURNS)))


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def trimmed(messages: Column, budget: int = HISTORY_CHARS) -> Column:
    """Newest messages first until the budget would be passed; the newest always stays."""
    size = lambda m: F.length(m["content"]) + F.length(F.array_join(m["names"], ", "))
    start = F.struct(F.slice(messages, 1, 0).alias("kept"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def step(s, m):
        stop = s["full"] | ((F.size(s["kept"]) > 0) & (s["total"] + size(m) > budget))
        return F.struct(F.when(stop, s["kept"]).otherwise(F.array_append(s["kept"], m)).alias("kept"),
                        F.when(stop, s["total"]).otherwise(s["total"] + size(m)).alias("total"), stop.alias("full"))

    return F.reverse(F.aggregate(F.reverse(messages), start, step, lambda s: s["kept"]))


def select_history(rows: DataFrame, message: str = "content", history: str = "history") -> DataFrame:
    """Add ``selected``: the messages of ``history`` that go with the current message."""
    rows = rows.withColumn("_n", T.history_norm(message)).withColumn("_terms", T.history_terms("_n")).withColumn(
        "_turns", turns_of(F.col(history)))
    n, terms, turns = F.col("_n"), F.col("_terms"), F.col("_turns")
    files = F.exists(F.element_at(turns, -1), lambda m: F.size(m["names"]) > 0)
    relevant = F.when(F.size(terms) == 0, F.slice(turns, 1, 0)).otherwise(
        _last(F.filter(turns, lambda t: is_relevant(t, n, terms)), HISTORY_TURNS))
    picked = F.when(F.size(turns) == 0, turns).when(is_memory_recall(n), recall_turns(n, turns)).when(
        is_follow_up(n, files), _last(turns, HISTORY_TURNS)).otherwise(relevant)
    return rows.withColumn("_picked", F.flatten(picked)).withColumn("selected", trimmed(F.col("_picked"))).drop(
        "_n", "_terms", "_turns", "_picked")


# -- prompts ---------------------------------------------------------------------------------

def file_excerpts(files, per_file: int = FILE_CHARS, total: int = ALL_FILES_CHARS) -> Column:
    """Excerpts (struct name, text) of text files in order under a per-file and a common budget."""
    start = F.struct(F.array().cast("array<struct<name:string,text:string>>").alias("out"), F.lit(total).alias("left"))

    def step(s, f):
        whole = T.strip(F.coalesce(f["text"], F.lit("")))
        usable = f["kind"].isin("text", "pdf") & (s["left"] > 0) & (whole != "")
        name = F.coalesce(F.nullif(T.strip(f["name"]), F.lit("")), F.lit("attachment"))
        part = T.strip(F.substr(whole, F.lit(1), F.least(F.lit(per_file), s["left"])))
        return F.when(usable & (part != ""), F.struct(
            F.array_append(s["out"], F.struct(name.alias("name"), part.alias("text"))).alias("out"),
            (s["left"] - F.length(part)).alias("left"))).otherwise(s)

    return F.aggregate(T.col(files), start, step, lambda s: s["out"])


def _with_notes(content: Column, notes: Column) -> Column:
    lead = F.when(content == "", F.lit(lists.ATTACHMENT_DEFAULT)).otherwise(content)
    return F.when(F.size(notes) > 0, T.strip(F.concat(
        lead, F.lit("\n\n" + lists.ATTACHMENT_MARKER + "\n\n"), F.array_join(notes, "\n\n")))).otherwise(content)


def history_message(m: Column) -> Column:
    """Earlier message as prompt text; its files are only named."""
    label = F.when(F.size(m["names"]) == 1, "Earlier attachment").otherwise("Earlier attachments")
    suffix = F.when(m["role"] == "user", " (re-upload if you want the assistant to reread the full contents).").otherwise(".")
    note = F.concat(F.lit("["), label, F.lit(": "), F.array_join(F.slice(m["names"], 1, 3), ", "), F.lit("]"), suffix)
    notes = F.when(F.size(m["names"]) > 0, F.array(note)).otherwise(F.array().cast("array<string>"))
    return _with_notes(T.strip(m["content"]), notes)


def current_message(content, files=None) -> Column:
    c = T.strip(content)
    if files is None:
        return c
    notes = F.transform(file_excerpts(files), lambda f: F.concat(F.lit("[Attached file: "), f["name"], F.lit("]\n"), f["text"]))
    pictures = F.transform(F.filter(T.col(files), lambda f: f["kind"] == "image"), lambda f: F.concat(
        F.lit("[Attached image: "), f["name"], F.lit("]")))
    return _with_notes(c, F.concat(notes, pictures))


def chat_prompts(messages: DataFrame, system_text: str, conv: str = "conv_id", order: str = "turn",
                 files: str | None = None) -> DataFrame:
    """One row per prompt message of every user turn: system text, selected history, current message."""
    rows = select_history(with_history(messages, conv, order)).filter("role = 'user' and safe")
    own = F.array(F.struct(F.lit("user").alias("role"), current_message("content", files).alias("content")))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")))
    body = F.transform("selected", lambda m: F.struct(m["role"].alias("role"), history_message(m).alias("content")))
    return rows.select(conv, order, F.posexplode(F.concat(head, body, own)).alias("message_no", "m")).select(
        conv, order, "message_no", "m.role", "m.content")


# -- outcomes ----------------------------------------------------------------------------------

def recall_excerpt(x) -> Column:
    return T.shorten(T.squeeze(x), RECALL_CHARS)


def recall_answer(message, selected, answer, force: bool = False) -> Column:
    """Answer about the conversation itself where the given one claims no memory; otherwise empty."""
    n = T.history_norm(message)
    s = T.col(selected)
    denies = F.lit(True) if force else T.any_of(T.history_norm(answer), lists.NO_MEMORY_PHRASES)
    said = lambda role: F.coalesce(T.strip(F.get(F.filter(
        s, lambda m: (m["role"] == role) & (T.strip(m["content"]) != "")), F.lit(0))["content"]), F.lit(""))
    user, reply = said("user"), said("assistant")
    first = (n.contains("first question") | n.contains("first thing")) & (user != "")
    story = T.any_of(n, lists.STORY_TERMS)
    text = (
        F.when(first, F.concat(F.lit('The first question I can see in this chat history was: "'), recall_excerpt(user), F.lit('"')))
        .when(story & (reply != ""), F.concat(F.lit('Yes. The earlier story I can see in this chat was in response to "'),
                                              recall_excerpt(user), F.lit('" and it began: "'), recall_excerpt(reply), F.lit('"')))
        .when(story & (user != ""), F.concat(F.lit('Yes. The story request I can see was: "'), recall_excerpt(user), F.lit('"')))
        .when(user != "", F.concat(F.lit('I can see this earlier message in the current chat history: "'), recall_excerpt(user), F.lit('"')))
        .otherwise(""))
    return F.when((F.size(s) > 0) & is_memory_recall(n) & denies, text).otherwise("")


def final_answers(rows: DataFrame, message: str = "content", answer: str = "answer", selected: str = "selected") -> DataFrame:
    """Add final_answer, blocked, blocked_category after recall and output policy."""
    given = T.strip(F.coalesce(answer, F.lit("")))
    rows = rows.withColumn("_a", F.when(given == "", "I could not generate a response.").otherwise(given))
    rows = rows.withColumn("_r", recall_answer(message, selected, "_a")).withColumn(
        "_a", F.when(F.col("_r") != "", F.col("_r")).otherwise(F.col("_a")))
    rows = with_policy(rows, "_a", "model_output", "_d").withColumn("_f", recall_answer(message, selected, "_a", force=True))
    hit = F.col("_d.blocked") & (F.col("_f") == "") & ~is_refusal("_a")
    text = F.when(F.col("_d.blocked") & (F.col("_f") != ""), F.col("_f")).when(hit, refusal_message("_d")).otherwise(F.col("_a"))
    return rows.withColumn("final_answer", text).withColumn("blocked", hit).withColumn(
        "blocked_category", F.when(hit, F.get("_d.categories", F.lit(0)))).drop("_a", "_r", "_d", "_f")


# -- budgets -----------------------------------------------------------------------------------

def _hint(prompt: Column, hints) -> Column:
    plain = [h for h in hints if all(ch.isalnum() or ch in "_+-" for ch in h)]
    loose = [h for h in hints if h not in plain]
    hit = F.lit(False)
    if plain:
        # the first letter is looked at before the word border, which costs far more in Unicode
        initials = "".join(sorted({T.quote(h[0]) for h in plain}))
        hit = hit | prompt.rlike(rf"(?U)(?=[{initials}])\b(?:" + "|".join(T.quote(h) for h in plain) + r")\b")
    if loose:
        hit = hit | T.any_of(prompt, loose)
    return hit


def prompt_text(content) -> Column:
    return F.lower(T.squeeze(F.substring_index(T.col(content), lists.ATTACHMENT_MARKER, 1)))


def intent(prompt: Column) -> Column:
    """What the message asks for, first match wins."""
    long = _hint(prompt, lists.LONG_ANSWER_HINTS) | F.concat(F.lit(" "), prompt, F.lit(" ")).contains(" long ") | prompt.contains("very long")
    simple = (F.length(prompt) <= 90) & prompt.rlike("^(?:" + "|".join(lists.SIMPLE_QUESTION_PREFIXES) + ")")
    return (F.when(_hint(prompt, lists.SHORT_ANSWER_HINTS), "brief").when(long & _hint(prompt, lists.LONG_FORM_NOUNS), "long_form")
            .when(_hint(prompt, lists.CODE_HINTS), "code").when(_hint(prompt, lists.LONG_ANSWER_HINTS), "detailed")
            .when(_hint(prompt, lists.LIST_HINTS), "list").when(simple, "simple").otherwise("plain"))


def context_budget(prompt_chars, images=0, vision: bool = False) -> Column:
    """Tokens left for the answer: four characters to a token, reserve and floor applied."""
    images = F.lit(images) if isinstance(images, int) else images
    used = F.greatest(F.lit(1), F.floor(T.col(prompt_chars) / 4))
    reserve = F.lit(512 + (768 if vision else 0)) + images * 256
    return F.greatest(F.lit(MIN_PREDICT), F.lit(VISION_CTX if vision else NUM_CTX) - used - reserve).cast("int")


def token_budget(content, prompt_chars, has_files=None, images=0, vision: bool = False) -> Column:
    """Output tokens granted to a message."""
    files = F.lit(vision) if has_files is None else (F.lit(vision) | has_files)
    ceiling = VISION_ANSWER if vision else MAX_ANSWER

    # kind and step are bound: unbound, each use would search the text for all hints again
    def stepped(p, kind):
        base = F.when(files, ceiling).otherwise(min(ceiling, 2400))
        return (F.when(kind == "brief", 384).when(kind == "long_form", ceiling).when(kind == "code", F.greatest(base, F.lit(3200)))
                .when(files, F.least(F.lit(ceiling), F.greatest(base, F.lit(1024))))
                .when(kind == "detailed", F.greatest(base, F.lit(3200))).when(kind == "list", F.greatest(base, F.lit(2200)))
                .when(kind == "simple", 1400).otherwise(base))

    def raised(p, step):
        several = F.length(p) - F.length(F.replace(p, F.lit("?"))) > 1
        step = (F.when(files & ((F.length(p) > 180) | several), F.least(F.lit(ceiling), F.greatest(step, F.lit(1280))))
                .when(~files & ((F.length(p) > 280) | several), F.greatest(step, F.lit(2400))).otherwise(step))
        room = context_budget(prompt_chars, images, vision)
        return F.greatest(F.lit(min(MIN_PREDICT, ceiling)), F.least(F.lit(ceiling), room, step)).cast("int")

    def granted(p):
        return T.let(T.let(intent(p), lambda kind: stepped(p, kind)), lambda step: raised(p, step))

    return T.let(prompt_text(content), granted)


def continuation_limit(content, vision: bool = False, configured: int | None = None) -> Column:
    most = min(8, max(0, configured if configured is not None else (VISION_CONTINUATIONS if vision else CONTINUATIONS)))
    if most == 0:
        return F.lit(0)
    return T.let(intent(prompt_text(content)), lambda k: F.when(k == "brief", min(most, 1)).when(
        k.isin("long_form", "code", "detailed"), most).otherwise(min(most, 2)))


# -- payloads ---------------------------------------------------------------------------------

def public_payload(payload) -> Column:
    """Payload entries without the internal ones, values as JSON text."""
    return F.map_filter(F.from_json(T.col(payload), "map<string,string>"), lambda k, v: ~k.isin(*lists.INTERNAL_PAYLOAD_KEYS))


def public_attachments(payload, session_id, message_id) -> Column:
    """Public fields of each attachment and its link."""
    found = F.from_json(F.get_json_object(T.col(payload), "$.attachments"), f"array<{ATTACHMENT}>")
    return F.transform(found, lambda a, i: F.struct(
        a["name"].alias("name"), a["kind"].alias("kind"), a["storage_path"].alias("storage_path"),
        a["text_path"].alias("text_path"), a["text_excerpt"].alias("text_excerpt"),
        F.concat(F.lit("/api/v1/sessions/"), T.col(session_id).cast("string"), F.lit("/chat/messages/"),
                 T.col(message_id).cast("string"), F.lit("/attachments/"), i.cast("string")).alias("download_url")))


def truncation_audit(messages: DataFrame, conv: str = "conv_id", content: str = "content", done_reason: str | None = None) -> DataFrame:
    """Cut-off assistant messages per conversation, and how many for each reason."""
    rows = messages.filter("role = 'assistant'").withColumn(
        "reason", truncation_reason(content, F.col(done_reason) if done_reason else None))
    return rows.groupBy(conv).agg(
        F.count("*").alias("responses"), F.count("reason").alias("cut_off"),
        *[F.count_if(F.col("reason") == reason).alias(reason) for reason in TRUNCATION_REASONS])
