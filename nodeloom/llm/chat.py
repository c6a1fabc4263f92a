"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are (role, first line of a turn or a later one). A line shows a speaker marker or none, its length, whether it
ends with a question mark, and whether it opens the transcript; the features count as independent given the state.
Probabilities are smoothed counts over labelled lines of a bounded sample of conversations; Viterbi gives the most
likely states, and runs between first lines become turns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: Labelled conversations that training reads, about.
SAMPLE = 3000
#: Lines after which the states that no later line can change are given out.
STRETCH = 4096
_MARKS = {"system": 0, "context": 0, "instructions": 0, "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2}
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?(" + "|".join(_MARKS) + r")(?:\]|\|?>|\*\*)?\s*(:|$|(?<=[\]>*])\s)(?:\*\*)?\s*", re.IGNORECASE)
STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int, str]:
    """(role that the line's marker names or 3, the line without the marker)."""
    m = _MARK.match(line)
    if not m or (m[2] != ":" and not re.match(r"^\s*(#|\[|<|\*)", line)):
        return 3, line
    return _MARKS[m[1].lower()], line[m.end() :]


def observe(line: str, opening: bool) -> tuple[int, int, int, int]:
    mark, rest = marker(line)
    return mark, min(len(rest).bit_length(), 11), int(rest.rstrip().endswith("?")), int(opening)


SIZES = (4, 12, 2, 2)


class Hmm:
    """Log probabilities from counts of labelled sequences, with one added to each count."""

    def __init__(self, start: np.ndarray, move: np.ndarray, seen: list[np.ndarray]):
        self.start = np.log((start + 1) / (start + 1).sum())
        self.move = np.log((move + 1) / (move + 1).sum(1, keepdims=True))
        self.seen = [np.log((x + 1) / (x + 1).sum(1, keepdims=True)) for x in seen]

    def viterbi(self, observed: list[tuple]) -> list[int]:
        """The most likely states."""
        path = Path(self)
        path.add(observed)
        return path.finish()


class Path:
    """Viterbi over lines that come bit by bit: the states are those of the whole sequence, however it is dealt.

    Lines that have not been given out keep back pointers of ``STATES`` bytes each. Where the ways back from all states meet, what lies before is settled.
    """

    def __init__(self, hmm: Hmm):
        self.hmm, self.score, self.back = hmm, None, np.zeros((0, STATES), np.int8)

    def add(self, observed: list[tuple]) -> None:
        if not observed:
            return
        obs = np.array(observed)
        emit = sum(x[:, obs[:, i]] for i, x in enumerate(self.hmm.seen)).T
        back = np.zeros((len(obs), STATES), np.int8)
        score = self.score
        for t in range(len(obs)):
            if score is None:
                score = self.hmm.start + emit[t]
                continue
            way = score[:, None] + self.hmm.move
            back[t] = way.argmax(0)
            score = way.max(0) + emit[t]
        self.score, self.back = score, np.concatenate([self.back, back])

    def _states(self, last: int, to: int) -> list[int]:
        """States of the lines before ``to``, whose last one is ``last``."""
        out = [last]
        for t in range(to - 1, 0, -1):
            out.append(int(self.back[t, out[-1]]))
        return out[::-1]

    def settled(self) -> list[int]:
        """States of the first of the lines that are left, as many as no later line can change; they go."""
        at = np.arange(STATES)
        for t in range(len(self.back) - 1, 0, -1):
            at = self.back[t][at]
            if (at == at[0]).all():
                states = self._states(int(at[0]), t)
                self.back = self.back[t:]
                return states
        return []

    def finish(self) -> list[int]:
        """States of the lines that are left."""
        if not len(self.back):
            return []
        states = self._states(int(self.score.argmax()), len(self.back))
        self.score, self.back = None, self.back[:0]
        return states


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def train(labelled: DataFrame) -> Hmm:
    """Fit on rows (conv_id, turn, role, text) whose texts may open with a marker; other roles and null ids are left out."""

    def count(batches):
        start, move, seen = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, n)) for n in SIZES]
        conv, last = None, -1
        for batch in batches:
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv:
                    conv, last = conv_id, -1
                for i, line in enumerate(_lines(text)):
                    state = 2 * ROLES.index(role) + (i > 0)
                    if last < 0:
                        start[state] += 1
                    else:
                        move[last, state] += 1
                    for x, o in zip(seen, observe(line, last < 0), strict=True):
                        x[state, o] += 1
                    last = state
        flat = np.concatenate([start, move.ravel(), *(x.ravel() for x in seen)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "n"])

    rows = labelled.select("conv_id", "turn", "role", "text").where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    convs = rows.agg(F.approx_count_distinct("conv_id")).first()[0]
    rows = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, convs))))
    rows = rows.repartition(common.shuffle_partitions(labelled.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn")
    flat = np.zeros(STATES + STATES**2 + STATES * sum(SIZES))
    for r in rows.mapInArrow(count, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        flat[r["i"]] = r["n"]
    cuts = np.cumsum([STATES, STATES**2, *(STATES * n for n in SIZES)])[:-1]
    start, move, *seen = np.split(flat, cuts)
    return Hmm(start, move.reshape(STATES, STATES), [x.reshape(STATES, -1) for x in seen])


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


_TURNS = "conv_id long, turn long, role string, n_lines long, rendered string"


def format_transcripts(parts: DataFrame, hmm: Hmm, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, n_lines, rendered): the turns recovered from transcripts whose lines stand in ``text_col`` in the order of ``order_col``.

    A transcript may be one row or many; its rows are streamed in order, never gathered. A null text is
    an empty line; rows with a null id form one transcript; repeated rows are read twice. Turns count from 0. No rows give no rows.
    """

    def run(batches):
        out: list[list] = [[] for _ in range(5)]
        conv, none = None, object()
        conv = none
        lines: list[str] = []
        path, told, ask = Path(hmm), 0, STRETCH
        turn, role, held, fresh = 0, None, [], True

        def close():
            nonlocal turn, role, held
            if role is not None:
                for c, v in zip(out, (conv, turn, ROLES[role], len(held), render(ROLES[role], "\n".join(held))), strict=True):
                    c.append(v)
                turn += 1
            role, held = None, []

        def decode(ended: bool):
            """Hand the lines to the path and take those that are settled; all, where the transcript has ended."""
            nonlocal lines, path, told, role, ask
            path.add([observe(x, fresh and told + i == 0) for i, x in enumerate(lines[told:])])
            states = path.finish() if ended else path.settled()
            for line, state in zip(lines, states, strict=False):
                if state % 2 == 0 or state // 2 != role:
                    close()
                    role = state // 2
                held.append(marker(line)[1])
            lines = lines[len(states) :]
            told = len(lines)
            ask = told + max(STRETCH, told)

        def batch_of():
            nonlocal out
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _TURNS.split(", ")])
            out = [[] for _ in range(5)]
            return made

        for batch in batches:
            for conv_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv is none or conv_id != conv:
                    decode(True)
                    close()
                    conv, turn, fresh, ask = conv_id, 0, True, STRETCH
                lines += _lines(text)
                if len(lines) >= ask:
                    decode(False)
                    fresh = False
            if out[0]:
                yield batch_of()
        decode(True)
        close()
        yield batch_of()

    n = common.shuffle_partitions(parts.sparkSession)
    rows = parts.select(F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("place"), F.col(text_col).alias("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place", "text").select("conv_id", "text").mapInArrow(run, _TURNS)


#: Ways in which a transcript may mark the speakers, by role.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System:\n", "### Human:\n", "### Assistant:\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("Context: ", "Q: ", "A: "),
    ("**System:** ", "**Human:** ", "**AI:** "),
)


def as_transcript(turns: DataFrame, unmarked: int = 8) -> DataFrame:
    """(conv_id, turn, role, text) with the marker of its conversation's style before each turn; one turn in ``unmarked`` (the first ones apart) has none."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, role in enumerate(ROLES):
        mark = F.when(F.col("role") == role, F.element_at(F.array(*[F.lit(s[i]) for s in STYLES]), style.cast("int") + 1)).otherwise(mark)
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0) & (F.col("turn") > 0)
    return turns.select("conv_id", "turn", "role", F.concat(F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = as_transcript(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    hmm = train(told.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1))
    return format_transcripts(told, hmm)


ORACLE = None
