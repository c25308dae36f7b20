"""Transcripts of an export: meetings, their lines in order with speaker and times, and search within lines.

A meeting's metanode has a tuple ``[SYS_A199, transcript]``; a transcript's children are its lines, and a line's metanode
has tuples with speaker and times.  Each step of that path is a join on ids; the marks of all lines are
turned into columns by one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import match_all
from .export_json import flatten

#: Marks of the tuples of meetings and lines (fixed values).
TRANSCRIPT = "SYS_A199"
LINE_MARKS = {"SYS_A252": "speaker", "SYS_A253": "start_time", "SYS_A254": "end_time"}


def marks(flat: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(owner, mark, value_id): what the tuples ``[mark, value]`` of metanodes say about the metanodes' owners."""
    meta = flat.filter("kind = 'metanode'").select("owner", F.explode("children").alias("tuple_id"))
    tuples = flat.select(F.col("id").alias("tuple_id"), F.get("children", F.lit(0)).alias("mark"), F.get("children", F.lit(1)).alias("value_id")).filter(F.col("mark").isin(list(wanted)))
    return meta.join(tuples, "tuple_id").select("owner", "mark", "value_id")


def meetings(docs: DataFrame) -> DataFrame:
    """(meeting_id, meeting, created, transcript_id, n_lines): meetings with a transcript that are not in the trash; a transcript of several counts for the first by id."""
    flat = flatten(docs)
    path = marks(flat, [TRANSCRIPT]).select(F.col("owner").alias("meeting_id"), F.col("value_id").alias("transcript_id"))
    meeting = flat.filter(~F.coalesce(F.col("owner").endswith("_TRASH"), F.lit(False))).select(F.col("id").alias("meeting_id"), F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("(unnamed)")).alias("meeting"), "created")
    script = flat.filter("kind = 'transcript'").select(F.col("id").alias("transcript_id"), F.coalesce(F.size("children"), F.lit(0)).alias("n_lines"))
    rows = path.join(meeting, "meeting_id").join(script, "transcript_id")
    first = rows.groupBy("transcript_id").agg(F.min(F.struct("meeting_id", "meeting", "created", "n_lines")).alias("x"))
    return first.select("x.meeting_id", "x.meeting", "x.created", "transcript_id", "x.n_lines")


def _said(flat: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines(line_id, ...)`` with speaker and times: the marks as columns, the largest of several."""
    value = flat.select(F.col("id").alias("value_id"), F.col("name").alias("value"))
    about = marks(flat, list(LINE_MARKS)).withColumnRenamed("owner", "line_id").join(lines.select("line_id").distinct(), "line_id", "left_semi").join(value, "value_id", "left")
    wide = about.groupBy("line_id").agg(*[F.max(F.when(F.col("mark") == m, F.col("value"))).alias(n) for m, n in LINE_MARKS.items()])
    return lines.join(wide, "line_id", "left")


def lines(docs: DataFrame) -> DataFrame:
    """(transcript_id, position, line_id, text, speaker, start_time, end_time) of all transcripts; children that do not exist are no lines."""
    flat = flatten(docs)
    of = flat.filter("kind = 'transcript'").select(F.col("id").alias("transcript_id"), F.posexplode("children").alias("position", "line_id"))
    rows = of.join(flat.select(F.col("id").alias("line_id"), F.col("name").alias("text")), "line_id")
    return _said(flat, rows).select("transcript_id", "position", "line_id", "text", *LINE_MARKS.values())


def search(docs: DataFrame, terms: Sequence[str], whole_words: bool = True) -> DataFrame:
    """(line_id, text, speaker, meeting_id, meeting) of the lines with all terms, as words or else anywhere in the text without case.

    Lines of transcripts without a meeting, or of a meeting in the trash, come without one.
    """
    flat = flatten(docs)
    every = flat.filter("kind = 'transcriptLine'").select(F.col("id").alias("line_id"), F.col("name").alias("text"))
    if whole_words:
        hits = match_all(every, terms)
    else:
        hits = every
        for t in terms:
            hits = hits.filter(F.lower("text").contains(t.lower()))
    of = flat.filter("kind = 'transcript'").select(F.col("id").alias("transcript_id"), F.explode("children").alias("line_id"))
    met = of.join(meetings(docs).select("transcript_id", "meeting_id", "meeting"), "transcript_id").groupBy("line_id").agg(F.min(F.struct("meeting_id", "meeting")).alias("m"))
    return _said(flat, hits).join(met, "line_id", "left").select("line_id", "text", "speaker", "m.meeting_id", "m.meeting")
