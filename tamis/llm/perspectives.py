"""Chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of the whole dialogue in which its own turns are the
assistant's and all other participants are named users, with the spans to train on. A rendering comes
in parts of bounded size, so that a dialogue of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.prefix import running_sums
from tamis.staging import stage_table

# Characters after which a rendering goes on in the next part; a part ends with a whole message.
PART_CHARS = 65_536
# Speakers that give instructions and take no part in the dialogue.
INSTRUCTIONS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """A text cannot open or close a message."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")


def rotate_perspectives(
    turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role",
    text: str = "text", instructions: tuple[str, ...] = INSTRUCTIONS, part_chars: int = PART_CHARS,
) -> DataFrame:
    """Render each dialogue once per participant.

    A row per dialogue, perspective and part: dialogue, perspective (the participant that is the
    assistant), part (from 0), start (the part's first character in the rendering), text, n_messages
    and masks (array of struct(start, end), places in ``text`` of what the assistant wrote, with its
    end marker). The parts of a rendering in order are the whole rendering.

    Names with white space or one of <>|%+ are percent-encoded, so different names stay different.
    Turns are ordered by turn number (nulls first), then speaker and a hash of the text; equal rows
    stay as repeated messages. A null speaker is the participant "unknown", a null text an empty message.
    Null dialogue ids form one dialogue. A dialogue with instructions alone has no perspective and
    no rows. Other columns are not read. No rows give no rows.
    """
    messages = stage_table(
        turns.select(
            F.col(dialogue).alias("dialogue"), F.col(turn).alias("turn"),
            F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
            _plain(F.col(text)).alias("content"), F.monotonically_increasing_id().alias("id"),
        ),
        "messages",
    )
    people = (
        messages.select(F.col("dialogue").alias("_d"), F.col("speaker").alias("perspective"))
        .where(~F.col("perspective").isin(*instructions)).distinct()
    )
    own = F.col("speaker") == F.col("perspective")
    name = F.when(F.col("speaker").rlike(r"[\s<>|%+]"), F.url_encode("speaker")).otherwise(F.col("speaker"))
    header = (
        F.when(own, F.lit(f"{OPEN}assistant\n"))
        .when(F.col("speaker").isin(*instructions), F.concat(F.lit(OPEN), name, F.lit("\n")))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    )
    # Places are summed over narrow rows; the contents join when their part is known.
    narrow = messages.select(
        "dialogue", "turn", "speaker", F.length("content").alias("n"), F.xxhash64("content").alias("hash"), "id"
    ).join(people, F.col("dialogue").eqNullSafe(F.col("_d")))
    narrow = narrow.select(
        "dialogue", "perspective", "turn", "speaker", "hash", "id", header.alias("header"), own.alias("own"),
        (F.length(header) + F.col("n") + F.lit(len(CLOSE) + 1)).cast("long").alias("chars"),
    )
    placed = running_sums(
        narrow, ["turn", "speaker", "hash", "id"], {"at": "chars"}, ["dialogue", "perspective"]
    )
    placed = placed.join(messages.select("id", "content"), "id")
    message = F.struct(
        "at", F.concat("header", "content", F.lit(f"{CLOSE}\n")).alias("text"), "own",
        F.length("header").alias("head"), F.col("chars").alias("chars"),
    )
    parts = placed.groupBy("dialogue", "perspective", F.floor(F.col("at") / part_chars).alias("part")).agg(
        F.array_sort(F.collect_list(message)).alias("m")
    )
    start = F.col("m")[0]["at"]
    masks = F.transform(
        F.filter("m", lambda x: x["own"]),
        lambda x: F.struct(
            (x["at"] - start + x["head"]).alias("start"), (x["at"] - start + x["chars"] - 1).alias("end")
        ),
    )
    return parts.select(
        "dialogue", "perspective", F.col("part").cast("int").alias("part"), start.alias("start"),
        F.array_join(F.transform("m", lambda x: x["text"]), "").alias("text"),
        F.size("m").alias("n_messages"), masks.alias("masks"),
    )
