"""Many phrases in many texts by one automaton.

A phrase is found wherever its letters follow one another in the text as whole words: between the letters of a word there may be white space and an
apostrophe, between words there must be something that is neither letter nor digit. So a text is read as its letters and what lies between them: one
automaton over the letters of all phrases finds where they may stand, and the gaps there decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of one automaton, all of which a task holds.
MOST = 100_000
NONE, LOOSE, APART = b"\x00", b"\x01", b"\x02"


class _Folded(dict):
    """Each character in one case, as a comparison without case has it; those that become several stay."""

    def __missing__(self, c: int) -> str:
        up = chr(c).upper()
        up = up if len(up) == 1 else chr(c)
        low = up.lower()
        self[c] = low = low if len(low) == 1 else up
        return low


_folded = _Folded()


def read(text: str) -> tuple[str, bytes]:
    """The letters of a text (digits, marks and underscores too), and what is before each and after the last: nothing, a loose gap (white space with at most one apostrophe), or more."""
    import regex

    letters, gaps, at = [], [], 0
    for m in regex.finditer(r"[\p{L}\p{M}\p{N}\p{Pc}]+", text):
        between = text[at : m.start()]
        gaps.append(APART if not at or not regex.fullmatch(r"\s*'?\s*", between) else LOOSE)
        gaps.append(NONE * (m.end() - m.start() - 1))
        letters.append(m[0])
        at = m.end()
    return "".join(letters).translate(_folded), b"".join(gaps) + APART


class Automaton:
    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.of: dict[str, list[tuple[int, bytes]]] = {}
        for k, phrase in enumerate(phrases):
            words = [read(w.replace("'", ""))[0] for w in phrase.split()]
            words = [w for w in words if w]
            if words:
                # 1 where a word of the phrase begins.
                begins = b"".join(b"\x01" + NONE * (len(w) - 1) for w in words)
                self.of.setdefault("".join(words), []).append((k, begins))
        self.machine = ahocorasick.Automaton()
        for letters in self.of:
            self.machine.add_word(letters, letters)
        if self.of:
            self.machine.make_automaton()

    def found(self, text: str) -> list[int]:
        """Numbers of the phrases that the text has, ascending."""
        letters, gaps = read(text)
        out: set[int] = set()
        if self.of and letters:
            for end, key in self.machine.iter(letters):
                first = end + 1 - len(key)
                if gaps[first : first + 1] == NONE or gaps[end + 1 : end + 2] == NONE:
                    continue
                here = gaps[first : end + 1]
                for k, begins in self.of[key]:
                    if k not in out and all(g != 0 if b else g != 2 for g, b in zip(here, begins)):
                        out.add(k)
        return sorted(out)


def phrase_hits(df: DataFrame, keys: list[str], text: str, phrases: DataFrame, most: int = MOST) -> DataFrame:
    """(keys, phrase): one row for each row of df and phrase (column phrase, each once) that its text has.

    Phrases are counted first and dealt into automata of at most about `most`; each goes to all tasks, which read all texts with it. Null texts have none, phrases without letters are nowhere.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    listed = phrases.where("phrase is not null").select("phrase").distinct()
    parts = max(1, -(-listed.count() // most))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "phrase string"])

    def one(part: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(sorted(r[0] for r in listed.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()))  # about `most`

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = shared.value
            automaton = Automaton(names)
            for batch in batches:
                rows, found = [], []
                for k, t in enumerate(batch.column(len(keys)).to_pylist()):
                    got = automaton.found(t) if t else []
                    rows += [k] * len(got)
                    found += [names[i] for i in got]
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keys)], pa.array(found, pa.string())], [*keys, "phrase"])

        return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [one(p) for p in range(parts)])
