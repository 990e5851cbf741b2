"""Token counts by the linear longest-match automaton.

The vocabulary is a trie with one root for pieces that begin a word and one
for pieces that continue it.  Each node has a failure link and, computed
beforehand, how many pieces are given out when it is followed; so greedy
longest-match-first counts come from one pass over a word's bytes, and no
piece is built.  All words that a batch holds for the first time run through
the automaton side by side, a byte at a time; very long ones one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Recent, byte_symbols
from .common import lean, sub_batches, text_view

_SPACE = byte_symbols()[32]
#: Words of more bytes run alone, so that few of them don't hold up the others' steps.
LONG_WORD = 512


def pieces_of(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuing pieces of a byte-level vocabulary file.

    Tokens that begin with a blank begin words, all others continue them; every
    single byte may do both, so each word has a way.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte = {c: b for b, c in enumerate(byte_symbols())}
    single = {bytes([b]) for b in range(256)}
    raw = lambda t: bytes(to_byte[c] for c in t)
    return {raw(t[1:]) for t in vocab if t[0] == _SPACE and len(t) > 1} | single, {raw(t) for t in vocab if t[0] != _SPACE} | single


class Automaton:
    """Greedy longest-match piece counts of words given as bytes."""

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        child: dict[int, int] = {}  # node * 256 + byte -> node
        parent, label, final = [0, 0], [0, 0], [False, False]
        for root, pieces in enumerate((initial, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    at = node << 8 | b
                    if at not in child:
                        child[at] = len(parent)
                        parent.append(node)
                        label.append(b)
                        final.append(False)
                    node = child[at]
                if piece:
                    final[node] = True
        self.child = child
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for v in range(2, n):
            depth[v] = depth[parent[v]] + 1
        fail, pops = [-1] * n, [0] * n  # root 1 is the state between pieces
        for v in np.argsort(depth, kind="stable").tolist():
            if v < 2:
                continue
            if final[v]:
                fail[v], pops[v] = 1, 1
                continue
            z, popped = fail[parent[v]], pops[parent[v]]
            while z >= 0 and (z << 8 | label[v]) not in child:
                popped += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = child[z << 8 | label[v]], popped
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.fail_list, self.pops_list = fail, pops
        keys = np.array(sorted(child), np.int64)
        self.keys, self.to = keys, np.array([child[k] for k in keys.tolist()], np.int64)
        self.first = np.full(256, -1, np.int64), np.full(256, -1, np.int64)  # the roots' children, most often asked for
        for root in (0, 1):
            for b in range(256):
                self.first[root][b] = child.get(root << 8 | b, -1)

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        want = states << 8 | letters
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; -1 for a word that the vocabulary cannot spell; 0 for an empty one."""
        if any(len(w) > LONG_WORD for w in words):
            out = np.array([self.count_one(w) if len(w) > LONG_WORD else 0 for w in words], np.int64)
            short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
            out[short] = self.count([words[i] for i in short])
            return out
        if not words:
            return np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")  # the words still running are always the first ones
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state = np.zeros(len(words), np.int64)
        count = np.zeros(len(words), np.int64)
        for i in range(int(sizes[0])):
            running = int(np.searchsorted(-sizes, -i, side="left"))
            todo = np.flatnonzero(state[:running] >= 0)
            letters = flat[starts[todo] + i]
            while len(todo):
                nxt = self._step(state[todo], letters)
                moved = nxt >= 0
                state[todo[moved]] = nxt[moved]
                todo, letters = todo[~moved], letters[~moved]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
                alive = state[todo] >= 0
                todo, letters = todo[alive], letters[alive]
        todo = np.flatnonzero((state != 1) & (state >= 0) & (sizes > 0))
        while len(todo):
            count[todo] += self.pops[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 1]
        count[state < 0] = -1
        out = np.empty_like(count)
        out[order] = count
        return out


    def count_one(self, word: bytes) -> int:
        """The same for one word, in time that grows with its length alone."""
        state, count = 0, 0
        child, fail, pops = self.child.get, self.fail_list, self.pops_list
        for b in word:
            while (nxt := child(state << 8 | b)) is None:
                count += pops[state]
                state = fail[state]
                if state < 0:
                    return -1
            state = nxt
        while state > 1:
            count += pops[state]
            state = fail[state]
        return -1 if state < 0 else count


_LOADED: dict[str, tuple[Automaton, Recent]] = {}


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word-piece lengths of every whole text, words being runs without ASCII white space.

    Returns doc_id, n_words, n_tokens and n_unknown; a word without a spelling
    counts one unknown token.  Null and empty texts count 0; null ids and
    repeated rows are counted row by row; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocab_path not in _LOADED:
            _LOADED[vocab_path] = Automaton(*pieces_of(vocab_path)), Recent()
        automaton, recent = _LOADED[vocab_path]
        for whole in batches:
            for batch in sub_batches(whole):
                words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
                known, new = recent.part(set().union(*words))
                made = dict(zip(new, automaton.count(new).tolist(), strict=True))
                recent.add(made)
                known.update(made)
                counts = [list(map(known.__getitem__, w)) for w in words]
                unknown = [c.count(-1) for c in counts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_words": pa.array(map(len, words), pa.int64()),
                        "n_tokens": pa.array([sum(c) + 2 * u for c, u in zip(counts, unknown, strict=True)], pa.int64()),
                        "n_unknown": pa.array(unknown, pa.int64()),
                    }
                )

    return text_view(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long, n_unknown long")
