"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: turns
that begin in the same step of tokens (slot) are a span, and a turn longer than a step is one of its
own. A window has the leading system turn, then of the turns before its span those that fit into the
history's budget, then its span. Assistant texts of the span are targets; system, history and user
texts and all markup are masked. Every turn is in the span of exactly one window, so every target
counts once. A step is half of what the conversation's system turn (or what is set aside for one, if that
is more) and the history leave of the budget. So a window fits the budget, unless its span is a single turn
that does not fit beside the system turn; then it has no history, is kept whole and is marked as over.

Format of a turn: BEGIN role newline text END. Control strings (of this format and of others) get a
backslash after their first character where they occur inside texts and roles, and backslashes are
doubled; reading back undoes both.

Prefix sums are taken within runs of RUN turns of a conversation and then over its runs; history is
found by an equi-join on steps of tokens. So no window function or join needs all turns of a
conversation in one place; a span ends where a run ends. A formatted window is put together per
(conversation, window), which the budget bounds.

Turns are in order of turn, then role, then text, nulls first. A null text is empty, a null role is the
empty role, rows with a null conv_id are one conversation. Repeated rows are turns of their own; a turn
number that recurs more than RUN times makes its run longer. Tokens are estimated without a tokenizer: words,
or a quarter of the UTF-8 bytes if that is more (as in texts without blanks), and one for the role.
Other columns are ignored. No rows give no windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import table, words
from blockloom.session import scratch_path, stored

# The format, and control strings that do not stand in texts as they are.
BEGIN, END = "<|turn|>", "<|end|>\n"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LINE_IN_ROLE = "<\\!"
RUN = 1024


@dataclass(frozen=True)
class Budget:
    tokens: int = 1024
    system: int = 128  # set aside for the system turn
    history: int = 256  # for repeated turns, at most

    def step(self, system: Column) -> Column:
        """Tokens of a step beside a system turn of so many."""
        left = F.lit(self.tokens - self.history) - F.greatest(system, F.lit(self.system))
        return F.greatest(F.floor(left / 2), F.lit(1))


def _guarded(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_guarded(c))), CONTROL, doubled)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, c: F.replace(t, F.lit(_guarded(c)), F.lit(c)), reversed(CONTROL), text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _piece(turn: Column) -> Column:
    role = F.replace(escape(turn["role"]), F.lit("\n"), F.lit(LINE_IN_ROLE))
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), escape(turn["text"]), F.lit(END))


def spans(conversations: DataFrame, budget: Budget) -> DataFrame:
    """Turns with their number and window: (c, conv_id, no, role, text, tokens, before, window)."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    rows = conversations.select(
        F.coalesce(conv.cast("string"), F.lit("null")).alias("c"),
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(turn / RUN), F.lit(-(1 << 40))).alias("run"),
    )
    counted = F.greatest(F.size(words(F.col("text"))), F.ceil(F.octet_length("text") / 4))
    rows = rows.withColumn("tokens", (counted + 1).cast("bigint"))
    runs = rows.groupBy("c", "run").agg(
        F.sum("tokens").alias("run_tokens"),
        F.count("*").alias("run_turns"),
        F.min(F.struct("turn", "role", "text", "tokens")).alias("head"),
    )
    system = F.when(F.col("head.role") == "system", F.col("head.tokens")).otherwise(0)
    runs = runs.select("c", "run", "run_tokens", "run_turns", system.alias("system"))
    earlier = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "c",
        "run",
        F.coalesce(F.sum("run_tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("run_turns").over(earlier), F.lit(0)).alias("turns_before"),
        budget.step(F.first("system").over(Window.partitionBy("c").orderBy("run"))).alias("step"),
    )
    order = Window.partitionBy("c", "run").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(runs, ["c", "run"])
    rows = rows.withColumn("local", F.row_number().over(order) - 1)
    rows = rows.withColumn("before", F.col("tokens_before") + F.sum("tokens").over(so_far) - F.col("tokens"))
    rows = rows.withColumn("slot", F.floor(F.col("before") / F.col("step")))
    rows = rows.withColumn("large", F.col("tokens") > F.col("step"))
    begins = (
        (F.col("local") == 0)
        | (F.col("slot") != F.lag("slot").over(order))
        | F.col("large")
        | F.lag("large").over(order)
    )
    rows = rows.withColumn("begins", begins)
    rows = rows.withColumn("span", F.sum(F.col("begins").cast("bigint")).over(so_far))
    first = F.first(F.when(F.col("begins"), F.col("turns_before") + F.col("local")), True)
    rows = rows.withColumn("window", first.over(Window.partitionBy("c", "run", "span")))
    return rows.select(
        "c", "conv_id", (F.col("turns_before") + F.col("local")).alias("no"), "role", "text", "tokens", "before", "window"
    )


def format_windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, window, text, n_repeated, n_turns, loss, n_tokens, over).

    window: number of the span's first turn; n_repeated: turns before the span; loss: array of
    (start, length) in characters of the text; n_tokens: of all turns; over: more than the budget.
    """
    turns = stored(spans(conversations, budget))  # read four times
    system = turns.where("no = 0 and role = 'system'").select(
        F.col("c").alias("sc"), F.col("role").alias("srole"), F.col("text").alias("stext"), F.col("tokens").alias("st")
    )
    windows = turns.groupBy("c", "window").agg(
        F.first("conv_id").alias("conv_id"), F.min("before").alias("begin"), F.sum("tokens").alias("own")
    )
    windows = windows.join(system, F.col("c") == F.col("sc"), "left")
    room = budget.tokens - F.greatest(F.coalesce("st", F.lit(0)), F.lit(0)) - F.col("own")
    windows = windows.withColumn("room", F.greatest(F.least(room, F.lit(budget.history)), F.lit(0)))

    repeated = windows.where("sc is not null and window > 0").select(
        "c", "window", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("no"), F.col("srole").alias("role"), F.col("stext").alias("text"), F.col("st").alias("tokens")
    )
    at = F.floor(F.col("begin") / budget.history)
    wanted = windows.where("window > 0 and room > 0").select(
        "c", "window", "begin", "room", F.col("sc").isNotNull().alias("has_system"), F.explode(F.array(at - 1, at)).alias("step")
    )
    past = turns.select("c", "no", "role", "text", "tokens", "before", F.floor(F.col("before") / budget.history).alias("step"))
    history = past.join(wanted, ["c", "step"]).where(
        "no < window and before >= begin - room and not (no = 0 and has_system)"
    )
    history = history.select("c", "window", F.lit(1).alias("part"), "no", "role", "text", "tokens")
    own = turns.select("c", "window", F.lit(2).alias("part"), "no", "role", "text", "tokens")

    every = own.unionByName(history).unionByName(repeated)
    grouped = every.groupBy("c", "window").agg(
        F.sort_array(F.collect_list(F.struct("part", "no", "role", "text", "tokens"))).alias("t")
    )
    pieces = grouped.select("c", "window", "t", F.transform("t", _piece).alias("pieces"))
    ends = F.transform(  # where the text of every turn ends
        F.sequence(F.lit(1), F.size("t")),
        lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p)) - len(END),
    )
    pieces = pieces.withColumn("ends", ends)
    marked = F.filter(
        F.zip_with(
            "t",
            "ends",
            lambda t, e: F.struct(
                ((t["part"] == 2) & (t["role"] == "assistant")).alias("target"),
                (e - F.length(escape(t["text"]))).cast("bigint").alias("start"),
                F.length(escape(t["text"])).cast("bigint").alias("length"),
            ),
        ),
        lambda z: z["target"],
    )
    out = pieces.select(
        F.when(F.col("c") != "null", F.col("c").cast("bigint")).alias("conv_id"),
        "window",
        F.array_join("pieces", "").alias("text"),
        F.size(F.filter("t", lambda t: t["part"] < 2)).alias("n_repeated"),
        F.size("t").alias("n_turns"),
        F.transform(marked, lambda z: F.struct(z["start"].alias("start"), z["length"].alias("length"))).alias("loss"),
        F.aggregate("t", F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )
    return out.withColumn("over", F.col("n_tokens") > budget.tokens)


def read_turns(formatted: DataFrame) -> DataFrame:
    """Formatted windows back to turns: (conv_id, window, turns, targets, chars).

    turns: (role, text) of the span; targets: the unescaped text under the loss mask.
    """
    parts = F.split("text", END.replace("|", "\\|"))
    own = F.slice(parts, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    rest = lambda x: F.substring(x, F.lit(len(BEGIN) + 1), F.length(x))
    turn = lambda x: F.struct(
        unescape(F.replace(F.substring_index(x, "\n", 1), F.lit(LINE_IN_ROLE), F.lit("\n"))).alias("role"),
        unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text"),
    )
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(
        "conv_id",
        "window",
        F.transform(F.transform(own, rest), turn).alias("turns"),
        targets.alias("targets"),
        F.length("text").cast("bigint").alias("chars"),
        "over",
    )


def op3_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations through formatted windows and back, a digest per conversation.

    A digest is of a whole conversation's text, which is therefore gathered in one row.
    """
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = scratch_path(spark, "chat")
    format_windows(rows).write.parquet(path)
    back = read_turns(spark.read.parquet(path))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select(
        "conv_id",
        F.struct("window", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"),
        F.size("turns").alias("n"),
        "chars",
        "over",
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"),
        F.sort_array(F.collect_list("w")).alias("w"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.count_if("over").alias("n_over"),
    )
    said = F.array_join(F.col("w.said"), "")
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
        "n_over",
    )
