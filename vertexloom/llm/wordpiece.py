"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; a node's failure link leads to where matching goes on once no longer piece can begin at its
start, and a count tells how many pieces that pops. A word's greedy longest-match length is thus counted in one pass over
its bytes, without building pieces (Song et al. 2021)."""

from __future__ import annotations

import functools
import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices

_WORDS = re.compile(r"\w+|[^\w\s]")
REMEMBERED = 200_000


class Automaton:
    """initial: pieces that may begin a word; rest: pieces that may follow."""

    def __init__(self, initial: set[bytes], rest: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, initial), (1, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    at = self.next[at][c]
                token[at] = at > 1
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if token[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of a word; one, the unknown piece, if greedy matching fails."""
        at, n = 0, 0
        for c in word:
            while c not in self.next[at]:
                if self.fail[at] < 0:
                    return 1
                n += self.popped[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at != 1:
            if self.fail[at] < 0:
                return 1 if word else 0
            n += self.popped[at]
            at = self.fail[at]
        return n


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """From a byte-level BPE vocabulary the pieces that begin words, those with a leading space, and those that follow, the
    others. Pieces of white space, and those that aren't whole UTF-8 characters, are in neither."""
    from tokenizers import Tokenizer, decoders

    tokens = json.loads(Tokenizer.from_file(path).to_str())["model"]["vocab"]
    level = decoders.ByteLevel()
    space = "Ġ"
    raw = {t: level.decode([t]).encode() for t in tokens}
    sound = {t: b for t, b in raw.items() if "�" not in b.decode()}
    initial = {b[1:] for t, b in sound.items() if t[0] == space and len(b) > 1 and not b[1:].isspace()}
    return initial, {b for t, b in sound.items() if t[0] != space and not b.isspace()}


@functools.cache
def from_byte_vocabulary(path: str) -> Automaton:
    return Automaton(*vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words (runs of letters, digits and underscores, and each other visible character),
    n_tokens (their pieces in all). A word that greedy matching can't cut, as one with characters that no whole piece has,
    counts one, the unknown piece.

    Null and empty texts have none. Repeated rows and null ids stay; extra columns are ignored; an empty table gives an
    empty result."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = from_byte_vocabulary(path)
        known: dict[str, int] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, tokens = [], []
                for text in part.column("text").to_pylist():
                    found = _WORDS.findall(text) if text else []
                    counts = list(map(known.get, found))
                    if None in counts:
                        for i, w in enumerate(found):
                            if counts[i] is None:
                                counts[i] = n = machine.count(w.encode())
                                if len(known) < REMEMBERED and len(w) <= 32:
                                    known[w] = n
                    words.append(len(found))
                    tokens.append(sum(counts))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
