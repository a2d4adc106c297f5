r"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles a ``<``,
any number of backslashes and a ``|`` get one backslash more before the ``|``, so no control
string can arise there and the step can be undone; a line feed in a role is ``<|line|>``.

Prefix sums of turn tokens place every turn of a conversation on one line of tokens. The line
is cut into sections of ``SECTION`` budgets; within a section, windows are spans of whole
turns that begin where the window before would pass its budget. A window repeats the leading
system turn and whole turns of up to ``history`` tokens that go before it, as far as the
budget has room; what is repeated is masked, so each assistant text is under the loss mask
once. Windows of a conversation depend on nothing but their own section, and only numbers are
gathered per section; texts move when turns meet their windows.

A turn is never cut: one that, with the system turn, is longer than the budget has a window of
its own without history, the only kind that passes the budget. A system turn longer than half
the budget is not repeated.

Edge cases: null texts and roles are empty; turns of a null number come first, equal numbers
are ordered by the hash of role and text; equal rows are turns of their own; a null
conversation id is a conversation. Empty input gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import persist

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
#: Tokens of a turn's frame, and budgets in a section.
FRAME, SECTION = 5, 16
#: Sections of a conversation whose windows meet one copy of its system turn.
SECTIONS_A_COPY = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def byte_tokens(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def placed_turns(turns: DataFrame) -> DataFrame:
    """Every turn (key, turn, mark, copy, tokens, system) with ``p``, the tokens of its conversation before it.

    Turns are sorted by conversation over all tasks; each task adds up its own turns, and the
    tasks' sums are added up per conversation.
    """
    once = turns.groupBy("key", "turn", "mark").agg(F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("system").alias("system"))
    sort = ["key", "turn", "mark"]
    ranged = persist(once.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("task", F.spark_partition_id()))
    size = F.col("tokens") * F.col("copies")
    sums = ranged.groupBy("key", "task").agg(F.sum(size).alias("size"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("size").over(before(Window.partitionBy("key").orderBy("task"))), F.lit(0).cast("long"))).drop("size")
    within = F.coalesce(F.sum(size).over(before(Window.partitionBy("key", "task").orderBy("turn", "mark"))), F.lit(0).cast("long"))
    local = ranged.withColumn("within", within).join(bases, ["key", "task"])
    copies = local.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copies.select("key", "turn", "mark", "tokens", "system", (F.col("base") + F.col("within") + F.col("copy") * F.col("tokens")).alias("p"))


def section_windows(turns: Column, first: Column, room: Column) -> Column:
    """The windows (begin, size) of a section: ``turns`` is an array of (p, tokens) in order, ``first`` the room of a conversation's first window."""
    none = F.lit(0).cast("long")
    state = F.struct(F.array_repeat(F.struct(none.alias("begin"), none.alias("size")), 0).alias("done"), F.lit(-1).cast("long").alias("begin"), none.alias("end"))
    closed = lambda s: F.when(s["begin"] < 0, s["done"]).otherwise(F.array_append(s["done"], F.struct(s["begin"].alias("begin"), (s["end"] - s["begin"]).alias("size"))))

    def step(s, t):
        end = t["p"] + t["tokens"]
        fresh = (s["begin"] < 0) | (end - s["begin"] > F.when(s["begin"] == 0, first).otherwise(room))
        return F.struct(F.when(fresh, closed(s)).otherwise(s["done"]).alias("done"), F.when(fresh, t["p"]).otherwise(s["begin"]).alias("begin"), end.alias("end"))

    return F.aggregate(turns, state, step, closed)


def format_conversations(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: Callable[[Column], Column] = byte_tokens, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str = "system", trained_role: str = "assistant") -> DataFrame:
    """conv_id, window (from 0), text, repeated, loss, tokens: the windows of every conversation.

    ``repeated`` is the number of turns at the window's head that an earlier window holds, and
    ``loss`` has the places (start, size; in code points, from 0) of the text to be learnt.
    """
    named = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = named.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "conv_id", "turn", "role", "text",
        F.xxhash64("role", "text").alias("mark"), (tokens("text") + tokens("role") + FRAME).alias("tokens"), (F.col("role") == system_role).alias("system"),
    )
    line = persist(placed_turns(turns).withColumn("section", F.floor(F.col("p") / (SECTION * budget))))
    heads = line.filter((F.col("p") == 0) & F.col("system") & (F.col("tokens") <= budget // 2)).select("key", F.col("tokens").alias("head"))
    spans = line.groupBy("key", "section").agg(F.array_sort(F.collect_list(F.struct("p", "tokens"))).alias("turns"))
    rest = F.lit(budget) - F.coalesce("head", F.lit(0))
    spans = spans.join(heads, "key", "left").select("key", "section", "head", section_windows(F.col("turns"), F.lit(budget), rest - history).alias("starts"))
    sections = Window.partitionBy("key").orderBy("section")
    follows = F.lead("section").over(sections) == F.col("section") + 1
    ahead = F.when(follows, F.lead("starts").over(sections))
    base = F.coalesce(F.sum(F.size("starts")).over(sections.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = persist(spans.select("key", "section", "head", "starts", F.coalesce(ahead, F.slice("starts", 1, 0)).alias("ahead"), base.cast("long").alias("base")))

    # A turn goes to its own window, and as history to those that begin soon behind it.
    number = lambda at: F.struct((F.col("base") + at).alias("window"), (at > F.col("own")).alias("again"))
    own = F.size(F.filter("starts", lambda s: s["begin"] <= F.col("p"))) - 1
    reach = lambda s: F.least(F.lit(history), rest - s["size"])
    soon = F.filter(F.transform(F.concat("starts", "ahead"), lambda s, i: F.struct(i.alias("at"), (s["begin"] - F.col("p")).alias("off"), reach(s).alias("reach"))), lambda s: (s["off"] > 0) & (s["off"] <= s["reach"]))
    leads = F.col("head").isNotNull() & (F.col("p") == 0)
    mine = line.join(spans, ["key", "section"]).withColumn("own", own)
    mine = mine.withColumn("to", F.explode(F.transform(F.concat(F.array("own"), F.when(leads, F.slice(F.array("own"), 1, 0)).otherwise(F.transform(soon, lambda s: s["at"]))), number)))
    mine = mine.select("key", "turn", "mark", "p", F.col("to.window").alias("window"), F.col("to.again").alias("again"))
    texts = turns.groupBy("key", "turn", "mark").agg(F.first("conv_id").alias("conv_id"), F.first("role").alias("role"), F.first("text").alias("text"))
    same = (F.col("m.key") == F.col("t.key")) & F.col("m.turn").eqNullSafe(F.col("t.turn")) & (F.col("m.mark") == F.col("t.mark"))
    whole = mine.alias("m").join(texts.alias("t"), same).select("m.key", "t.conv_id", "m.window", "m.p", "m.again", "t.role", "t.text")

    # The system turn goes to every later window; a copy of it serves some sections.
    leading = whole.filter((F.col("p") == 0) & (F.col("window") == 0) & (F.col("role") == system_role)).join(heads.select("key"), "key", "left_semi")
    copies = spans.groupBy("key").agg(F.floor(F.max("section") / SECTIONS_A_COPY).alias("copies"))
    leading = leading.join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies"))))
    others = spans.filter(F.col("head").isNotNull()).select("key", F.floor(F.col("section") / SECTIONS_A_COPY).alias("copy"), F.explode(F.sequence(F.col("base"), F.col("base") + F.size("starts") - 1)).alias("w")).filter(F.col("w") > 0)
    leading = leading.join(others, ["key", "copy"]).select("key", "conv_id", F.col("w").alias("window"), "p", F.lit(True).alias("again"), "role", "text")

    written = whole.unionByName(leading).withColumn("open", F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    trained = (F.col("role") == trained_role) & ~F.col("again")
    turn = F.struct("p", "again", "open", "body", trained.alias("trained"), (tokens("text") + tokens("role") + FRAME).alias("tokens"))
    windows = written.groupBy("key", "window").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    begins = F.aggregate(
        "turns", F.struct(F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size")), 0).alias("loss"), F.lit(0).cast("long").alias("at")),
        lambda s, t: F.struct(
            F.when(t["trained"], F.array_append(s["loss"], F.struct((s["at"] + F.char_length(t["open"])).alias("start"), F.char_length(t["body"]).cast("long").alias("size")))).otherwise(s["loss"]).alias("loss"),
            (s["at"] + F.char_length(t["open"]) + F.char_length(t["body"]) + len(END) + 1).alias("at"),
        ),
        lambda s: s["loss"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["open"], t["body"], F.lit(END + "\n"))), "")
    return windows.select("conv_id", "window", text.alias("text"), F.size(F.filter("turns", lambda t: t["again"])).alias("repeated"), begins.alias("loss"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("tokens"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a window, as they were."""
    parts = F.split(text, r"<\|im_end\|>\n")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda t: F.instr(t, "\n")
    return F.transform(turns, lambda t: F.struct(
        unescaped(F.replace(F.substr(t, F.lit(len(START) + 1), cut(t) - len(START) - 1), F.lit(LINE), F.lit("\n"))).alias("role"),
        unescaped(F.substr(t, cut(t) + 1)).alias("text"),
    ))


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, unescaped."""
    return F.transform(loss, lambda m: unescaped(F.substr(text, (m["start"] + 1).cast("int"), m["size"].cast("int"))))


def read_conversations(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from formatted windows."""
    turns = read_turns(F.col("text"))
    fresh = F.slice(turns, F.col("repeated") + 1, F.size(turns) - F.col("repeated"))
    told = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(read_loss(F.col("text"), F.col("loss")), "")
    per = windows.select("conv_id", "window", F.size(fresh).alias("n"), told.alias("told"), learnt.alias("learnt"), F.char_length("text").cast("long").alias("chars"))
    whole = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "told", "learnt"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = whole.select("*", F.array_join(F.transform("w", lambda x: x["told"]), "").alias("told"), F.array_join(F.transform("w", lambda x: x["learnt"]), "").alias("learnt"))
    return joined.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
