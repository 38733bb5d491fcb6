"""Chat formatting from event logs, in DataFrame functions only.

``messages`` folds a log into final messages, ``rendered`` writes them in a template with a loss mask, and ``read_back``
takes the output apart again. Events: conv_id, message (a key that sorts in page order), seq, kind, role, text.
Kinds: ``message`` opens or replaces a message, ``edit`` and ``regenerate`` replace its text so far, ``delta``
appends to it. A message's role is the last one that an opening, edit or regeneration names; deltas name it only where none of those does.

Defined cases: null text is empty, null role is the empty role, a null kind is ``message``, a null conversation id is a
conversation like any other; nulls sort first; deltas before any opening are appended to nothing and stay;
of equal seq numbers the order is kind, then text, so the last of two equal edits replaces the other. Repeated messages must come with keys of their own. Other columns
are left alone; an empty log gives no rows. One output row holds one conversation, so the longest one must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    """No control string is left in it: backslashes double, ``<|`` becomes ``<\\|``."""
    return _swap(text, ("\\", "\\\\"), ("<|", "<\\|"))


def unescaped(text: Column) -> Column:
    return _swap(text, ("<\\|", "<|"), ("\\\\", "\\"))


def messages(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: each message's state after all its events, taken in the order of seq, kind and text."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    opens = lambda e: e["kind"] != "delta"
    roles = lambda some: F.transform(F.filter("log", lambda e: some(e) & e["role"].isNotNull()), lambda e: e["role"])
    opened = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(opens(e), i))), F.lit(0))
    since = F.slice("log", opened + 1, F.greatest(F.size("log"), F.lit(1)))
    return (
        events.groupBy("conv_id", "message")
        .agg(F.array_sort(F.collect_list(event)).alias("log"))
        .select(
            "conv_id",
            "message",
            F.coalesce(F.get(F.reverse(roles(opens)), F.lit(0)), F.get(roles(lambda e: ~opens(e)), F.lit(0)), F.lit("")).alias("role"),
            F.array_join(F.transform(since, lambda e: e["text"]), "").alias("text"),
        )
    )


def rendered(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted (the whole string) and segments (array of text, loss) that spell it; loss marks ``learned`` texts only."""
    head = F.concat(F.lit(START), _swap(escaped(F.col("role")), ("\n", "<\\/")), F.lit("\n"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    parts = F.array(segment(head, no), segment(escaped(F.col("text")), F.col("role") == learned), segment(F.lit(END + "\n"), no))
    return (
        turns.select("conv_id", F.struct("message", parts.alias("parts")).alias("turn"))
        .groupBy("conv_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["parts"])).alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")
    )


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) parsed from ``formatted``, loss_text from the mask, formatted_chars."""
    raw = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda t: t != "")
    bare = lambda t: F.regexp_replace(t, r"<\|im_end\|>\n$", "")
    turns = F.transform(
        raw,
        lambda t: F.struct(
            unescaped(_swap(F.substring_index(t, "\n", 1), ("<\\/", "\n"))).alias("role"),
            unescaped(F.substr(bare(t), F.locate("\n", t) + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return output.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").alias("formatted_chars"))
