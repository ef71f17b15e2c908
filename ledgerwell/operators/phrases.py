"""Many phrases at once: which of a table of phrases occur in which texts, by one automaton over all of them.

The phrases go to the tasks with their code, in blocks of at most BLOCK characters; a block is one pass over the texts and reads
each character once, however many phrases it holds. Texts are compared in lower case, or as they are; a phrase counts at every place it occurs,
overlaps included, and inside words as well, unless whole words are asked for. Null texts and empty phrases have no hits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwell.operators.dense import _union

#: Characters of phrases in one automaton, some 200 bytes of memory each.
BLOCK = 1 << 20


def _blocks(phrases: DataFrame, lower: bool) -> Iterator[list[tuple[int, str]]]:
    """Phrases in blocks, in order of their numbers, one partition at a time."""
    block, size = [], 0
    rows = phrases.select(F.col("phrase_id").cast("long"), (F.lower("phrase") if lower else F.col("phrase")).alias("phrase")).where("phrase <> ''").orderBy("phrase_id")
    for number, phrase in rows.toLocalIterator():
        if block and size + len(phrase) > BLOCK:
            yield block
            block, size = [], 0
        block.append((number, phrase))
        size += len(phrase)
    if block:
        yield block


def hits(rows: DataFrame, key: str, column: str, phrases: DataFrame, words: bool = False, lower: bool = True) -> DataFrame:
    """(key, phrase_id, n, first) of the phrases (phrase_id, phrase) in each text: how often, and the first place (from 0).

    words: only where neither a letter nor a digit stands next to a phrase's ends. lower: without regard to case."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, phrase_id bigint, n bigint, first bigint"

    def visit(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            same: dict[str, list[int]] = {}
            for number, phrase in block:
                same.setdefault(phrase, []).append(number)
            automaton = ahocorasick.Automaton()
            for phrase, numbers in same.items():
                automaton.add_word(phrase, (len(phrase), numbers))
            automaton.make_automaton()
            for b in batches:
                at, found, counts, firsts = [], [], [], []
                for row, text in enumerate(b.column(1).to_pylist()):
                    n: Counter = Counter()
                    first: dict[int, int] = {}
                    for end, (size, numbers) in automaton.iter(text or ""):
                        start = end - size + 1
                        if words and (text[start - 1 : start].isalnum() or text[end + 1 : end + 2].isalnum()):
                            continue
                        for number in numbers:
                            n[number] += 1
                            first.setdefault(number, start)
                    at += [row] * len(n)
                    found += n.keys()
                    counts += n.values()
                    firsts += [first[k] for k in n]
                names = b.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([names, pa.array(found, pa.int64()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], [key, "phrase_id", "n", "first"])

        return rows.select(key, (F.lower(column) if lower else F.col(column)).alias(column)).mapInArrow(run, schema)

    return _union([visit(block) for block in _blocks(phrases, lower)], rows, schema)
