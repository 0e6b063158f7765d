"""Conversations: what a turn is about, given the turns before it.

Windows serve where a rule looks at all earlier turns alike; the turn planner,
whose state depends on its own earlier decisions, is a fold over the turns of one
conversation, over sorted rows in batch and as state in streams.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import anchor_terms, collapse_dotted, is_followup, normal, stem
from quern.operators.ambiguity import SHORT, names_one
from quern.profile import MACEDONIAN, Profile

HISTORY_TURNS = 4


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", messages: int = 2 * HISTORY_TURNS) -> DataFrame:
    """turns with history: the texts of the last messages before each."""
    frame = Window.partitionBy(conv).orderBy(turn).rowsBetween(-messages, -1)
    return turns.withColumn("history", F.collect_list(text).over(frame))


def topic(turns: DataFrame, subject: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """turns with topic: the last earlier message that carries a subject."""
    frame = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("topic", F.last(subject, ignorenulls=True).over(frame))


def seen(turns: DataFrame, docs: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """turns with seen: distinct documents of all earlier turns, in order of appearance.

    Each document counts at its first turn only, so what a turn gathers is no more
    than what is shown to it.
    """
    one = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.posexplode(docs).alias("i", "d"))
    first = one.groupBy("c", "d").agg(F.min(F.struct("t", "i")).alias("at")).select("c", F.col("at.t").alias("t"), "at.i", "d")
    new = first.groupBy("c", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("new"))
    marked = turns.join(new, (F.col(conv) == F.col("c")) & (F.col(turn) == F.col("t")), "left").drop("c", "t")
    frame = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("seen", F.flatten(F.collect_list("new").over(frame))).drop("new")


def cue_stems(profile: Profile = MACEDONIAN) -> Column:
    """Stems of the words that ask for a section: they say what is wanted, not about what."""
    cues = sorted({c for cues in profile.intents.values() for c in cues if " " not in c})
    return F.array(*[stem(F.lit(c), profile) for c in cues])


def subject_terms(turns: DataFrame, frequency: DataFrame, n_blocks: int, text: str = "text", key: tuple[str, ...] = ("conv_id", "turn"), share: float = 0.10, profile: Profile = MACEDONIAN) -> DataFrame:
    """(key, term): anchor terms that can name a subject.

    A term goes that begins like a cue's stem, or that a cue's stem begins with;
    some blocks must hold it, but at most a tenth of them.
    """
    terms = F.transform(anchor_terms(text, profile), lambda t: F.struct(t.alias("t"), F.exists(cue_stems(profile), lambda c: F.startswith(t, c) | F.startswith(c, t)).alias("cue")))
    asked = turns.select(*key, F.explode(F.transform(F.filter(terms, lambda x: ~x["cue"]), lambda x: x["t"])).alias("term"))
    held = frequency.where((F.col("df") > 0) & (F.col("df") <= share * n_blocks)).select("term")
    return asked.join(held, "term", "left_semi").select(*key, "term")


def subjects(turns: DataFrame, frequency: DataFrame, n_blocks: int, text: str = "text", key: tuple[str, ...] = ("conv_id", "turn"), share: float = 0.10, profile: Profile = MACEDONIAN) -> DataFrame:
    """(key) of turns with a subject."""
    return subject_terms(turns, frequency, n_blocks, text, key, share, profile).select(*key).distinct()


def with_subject(turns: DataFrame, frequency: DataFrame, n_blocks: int, conv: str = "conv_id", turn: str = "turn", text: str = "text", profile: Profile = MACEDONIAN) -> DataFrame:
    """turns with subject: what plan() takes as the turns that may become a topic."""
    found = subjects(turns, frequency, n_blocks, text, (conv, turn), profile=profile).withColumn("subject", F.lit(True))
    return turns.drop("subject").join(found, [conv, turn], "left").withColumn("subject", F.coalesce("subject", F.lit(False)))


@dataclass
class State:
    topic: str | None = None
    pending: str | None = None


PLAN = "turn long, query string, how string"


def planned(state: State, text: str, followup: bool, subject: bool, ambiguous: bool) -> tuple[str, str]:
    """The query to run for a message, and why; state moves on.

    A reply to a pending question joins it; a reply that leaves it open is asked
    again.  A follow-up, or a message without a subject, joins the topic.  The
    topic changes only on answered turns, to the first message or one with a subject.
    """
    if state.pending is not None:
        query, how = f"{state.pending} {text}".strip(), "reply"
    elif state.topic and (followup or not subject):
        query, how = f"{state.topic} {text}".strip(), "topic"
    else:
        query, how = text, "plain"
    if ambiguous:
        state.pending = text if state.pending is None else state.pending
        return query, how
    state.pending = None
    if state.topic is None or subject:
        state.topic = text
    return query, how


def plan(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", subject: str | None = None, ambiguous: str | None = None) -> DataFrame:
    """(conv, turn, query, how) of every turn of a named conversation.

    Its turns pass one task in order, in batches; what is held is two texts.
    """
    kind = turns.schema[conv].dataType.simpleString()
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text"), is_followup(text).alias("followup"), (F.col(subject) if subject else F.size(anchor_terms(text)) > 0).alias("subject"), (F.col(ambiguous) if ambiguous else F.lit(False)).alias("ambiguous"))

    def fold(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        at, state = None, State()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if r.conv != at:
                    at, state = r.conv, State()
                out.append((r.conv, r.turn, *planned(state, r.text, bool(r.followup), bool(r.subject), bool(r.ambiguous))))
            yield pd.DataFrame(out, columns=["conv", "turn", "query", "how"])

    sorted_ = own.where("conv IS NOT NULL").repartition("conv").sortWithinPartitions("conv", "turn", "text")
    return sorted_.mapInPandas(fold, f"conv {kind}, {PLAN}").withColumnRenamed("conv", conv)


def scopes(plans: DataFrame, turns: DataFrame, named: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """plans with service_scope, variation_scope and form_scope: what the search of each turn is narrowed to.

    turns also have the service that each is about, null where there is none, and
    its variations (id, names), in the order in which they are offered; named is
    (conv, turn, forms).  A reply or a follow-up that names a variation of the last
    service is narrowed to it, a reply to that service too; a plain message to the
    legal forms that it names.
    """
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("service").isNotNull(), F.struct("service", "variations")), ignorenulls=True).over(before)
    own = turns.select(conv, turn, normal(collapse_dotted(F.coalesce(text, F.lit("")))).alias("q"), last.alias("last"))
    met = F.filter("last.variations", lambda v: names_one(F.col("q"), F.transform(v["names"], lambda n: F.lower(n))))
    own = own.select(conv, turn, F.col("last.service").alias("service"), F.get(met, F.lit(0))["id"].alias("variation"))
    both = plans.join(own, [conv, turn], "left").join(named, [conv, turn], "left")
    narrowed = F.col("variation").isNotNull()
    return both.select(
        plans["*"],
        F.when((F.col("how") == "reply") & narrowed, F.col("service")).alias("service_scope"),
        F.when(F.col("how") != "plain", F.col("variation")).alias("variation_scope"),
        F.when((F.col("how") == "plain") & (F.size("forms") > 0), F.col("forms")).alias("form_scope"),
    )


@dataclass
class Session(State):
    """What a conversation's turns leave for the next: besides topic and question the last service, what it offers, and when the last turn was."""

    service: int | None = None
    offered: str | None = None
    at: int | None = None
    turn: int | None = None


TURN = "turn long, query string, how string, service_scope long, variation_scope long, form_scope array<string>"


def says(q: str, names: list[str]) -> bool:
    """names_one() for one reply in normal form."""
    whole = lambda x: re.search(rf"(?<!\w){re.escape(x)}(?!\w)", q) is not None
    for name in map(str.lower, names):
        if whole(name) if len(name) <= SHORT else name in q or any(whole(p) for p in map(str.strip, name.split(",")) if len(p) > 1):
            return True
    return False


def turn_rows(session: Session, rows: Iterable, idle_ms: int) -> Iterator[tuple]:
    """The columns of TURN for turns of one conversation in order; a row `expired` where a gap ends a session."""
    for r in rows:
        if session.at is not None and r.ms - session.at > idle_ms:
            yield session.turn, None, "expired", None, None, None
            session.__init__()
        query, how = planned(session, r.text, bool(r.followup), bool(r.subject), bool(r.ambiguous))
        met = next((v["id"] for v in json.loads(session.offered) if says(r.q, v["names"])), None) if session.service is not None and how != "plain" else None
        forms = [str(f) for f in r.forms] if how == "plain" and r.forms is not None and len(r.forms) else None
        yield int(r.turn), query, how, session.service if how == "reply" and met is not None else None, met, forms
        if r.service is not None and r.service == r.service:
            session.service, session.offered = int(r.service), r.offered or "[]"
        session.at, session.turn = int(r.ms), int(r.turn)


def turn_columns(turns: DataFrame) -> DataFrame:
    """What turn_rows() reads, from (conv_id, turn, ts, text, subject, ambiguous, service, variations, forms); ts stays for watermarks."""
    t = F.coalesce("text", F.lit(""))
    return turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "ts", F.unix_millis("ts").alias("ms"), t.alias("text"), is_followup("text").alias("followup"), "subject", "ambiguous",
        normal(collapse_dotted(t)).alias("q"), F.col("service").cast("long").alias("service"), F.to_json("variations").alias("offered"), "forms",
    )


def plan_sessions(turns: DataFrame, idle_ms: int) -> DataFrame:
    """Plans and scopes of all turns, where a gap of more than idle_ms begins anew.

    turns are those of turn_columns(); a conversation's pass one task in order, in
    batches; the last session of a conversation has no row that says it expired.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        at, session = None, Session()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if r.conv != at:
                    at, session = r.conv, Session()
                out += [(r.conv, *x) for x in turn_rows(session, [r], idle_ms)]
            yield turn_frame(out)

    ordered = turn_columns(turns).where("conv IS NOT NULL").repartition("conv").sortWithinPartitions("conv", "turn", "text")
    return ordered.mapInPandas(fold, f"conv_id {kind}, {TURN}")


def turn_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", *(f.split()[0] for f in TURN.split(", "))])
    return frame.astype({"turn": "Int64", "service_scope": "Int64", "variation_scope": "Int64"})
