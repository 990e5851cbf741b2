"""Byte-level BPE encoding and decoding by a pair occurrence index.

New pre-tokens of a batch are laid out as one linked list of byte symbols.  An
index maps each adjacent pair that has a merge rank to all its positions in
the batch; a heap holds the active ranks.  The lowest rank is applied at every
position of its list at once, left to right, and the lists of the pairs that
appear around the merged symbols are extended.  Every merge rank of a trained
vocabulary is higher than the ranks of the merges that made its parts, so
ascending ranks over the whole batch give what encoding each word alone gives.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, sub_batches, text_view

#: Ready-encoded words in each of a worker's tables.
CACHE_WORDS = 200_000
#: Words longer than this many characters are encoded but not kept.
CACHE_CHARS = 48

_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_TIGHT = re.compile(r"\s\s|\A\s|\s\Z")
_CLASSES = (("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(r"\s")))
#: For a character whose class the tokenizer's older Unicode tables see otherwise.
_STAND_IN = {"L": "a", "N": "1", "S": "\n", "O": "!"}


def _crowded(text: str) -> bool:
    """Does white space begin or end the text, or stand beside white space?"""
    if text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return bool(_OTHER_SPACE.search(text)) and bool(_TIGHT.search(text))


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, all others are numbered
    from 256 in byte order.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent:
    """Words with their ids: a young and an old table of bounded size; what is used again stays."""

    def __init__(self, most: int = CACHE_WORDS):
        self.most, self.young, self.old = most, {}, {}

    def part(self, wanted: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is known of ``wanted``, and the rest."""
        known, unknown, young, old = {}, [], self.young.get, self.old.get
        for w in wanted:
            if (ids := young(w)) is not None:
                known[w] = ids
            elif (ids := old(w)) is not None:
                known[w] = self.young[w] = ids
            else:
                unknown.append(w)
        return known, unknown

    def add(self, made: dict[str, bytes]) -> None:
        if len(self.young) + len(made) > self.most:
            self.old, self.young = self.young, {}
        if len(made) <= self.most:
            self.young.update((w, ids) for w, ids in made.items() if len(w) <= CACHE_CHARS)


class ByteBPE:
    """One vocabulary file of the ``tokenizers`` format with ranks, ids and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.token_bytes[i] = raw(token)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            self.token_bytes[i] = text.encode()
        self.token_sizes = np.array(list(map(len, self.token_bytes)))
        self.byte_id = [vocab[c] for c in byte_symbols()]
        self._byte_ids = np.array(self.byte_id, np.int64)
        self._merge: list[tuple[int, int, int]] = []  # by rank: left, right and merged id
        for pair in spec["model"]["merges"]:
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            self._merge.append((vocab[left], vocab[right], vocab[left + right]))
        packed = np.array([a << 32 | b for a, b, _ in self._merge], np.int64)
        self._pair_rank = np.argsort(packed, kind="stable")
        self._pairs = packed[self._pair_rank]
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._spaced, self._plain, self._words = Recent(), Recent(), Recent()
        self._odd: dict[str, str] = {}
        self._seen: set[str] = set(map(chr, range(128)))
        self._path = path
        self._prober = self._libraries = None
        self._newline = self._pack([self.byte_id[10]])

    @staticmethod
    def _pack(ids) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    # -- pre-tokens ---------------------------------------------------------

    def _learn_classes(self, text: str) -> None:
        """Ask the tokenizer for the class of characters not met before."""
        for c in set(text) - self._seen:
            if self._prober is None:
                import tokenizers

                self._prober = tokenizers.Tokenizer.from_file(self._path).pre_tokenizer
            theirs = next((k for k, s in (("L", "a"), ("N", "1"), ("O", "!")) if len(self._prober.pre_tokenize_str(s + c + s)) == 1), "S")
            ours = next((k for k, p in _CLASSES if p.match(c)), "O")
            if ours != theirs:
                self._odd[c] = _STAND_IN[theirs]
            self._seen.add(c)

    def _pretokens(self, text: str) -> list[str]:
        if self._odd and not self._odd.keys().isdisjoint(text):
            shadow = text.translate({ord(c): s for c, s in self._odd.items()})
            return [text[m.start() : m.end()] for m in _PATTERN.finditer(shadow)]
        return _PATTERN.findall(text)

    def _word_pretokens(self, lead: str, word: str) -> list[str]:
        """Those of a blank or nothing and a word that holds no blank."""
        if not self._odd:
            if word.isalpha():
                return [lead + word]
            if word[-1:] in ".,!?;:" and word[:-1].isalpha():
                return [lead + word[:-1], word[-1]]
        return self._pretokens(lead + word)

    # -- the pair occurrence index ------------------------------------------

    def _ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """Merge ranks of packed pairs, -1 where the vocabulary has no merge."""
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._pair_rank[at], -1)

    def library_ids(self, text: str) -> np.ndarray:
        """Ids of one text by the tokenizers' own libraries.

        tiktoken has the same merges where ids follow ranks, at several times
        the speed; texts with characters whose classes the two libraries see
        differently, or with added tokens, go to tokenizers.
        """
        if self._libraries is None:
            import tiktoken
            import tokenizers

            base = len(self.byte_id)
            by_rank = sorted(self.byte_id) == list(range(base)) and all(made == base + r for r, (_, _, made) in enumerate(self._merge))
            table = tiktoken.Encoding("ranks", pat_str=_PATTERN.pattern, mergeable_ranks={self.token_bytes[i]: i for i in range(base + len(self._merge))}, special_tokens={}) if by_rank else None
            self._libraries = table, tokenizers.Tokenizer.from_file(self._path)
            self._libraries[1].no_truncation()
            self._libraries[1].no_padding()
        table, whole = self._libraries
        if not text.isascii():
            self._learn_classes(text)
        if table is None or self._odd and not self._odd.keys().isdisjoint(text) or any(a in text for a in self.added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return table.encode_to_numpy(text, disallowed_special=())

    def _merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as bytes; all pre-tokens of the call share one index."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        sym = self._byte_ids[flat]
        sym[ends] = -1
        n = len(sym)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Add positions whose pair has a rank to the lists of the index."""
            right = sym[after[places]]
            ranks = self._ranks_of(np.where((sym[places] < 0) | (right < 0), -1, sym[places] << 32 | right))
            keep = ranks >= 0
            if not keep.any():
                return
            places, ranks = places[keep], ranks[keep]
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True)
            else:
                groups = ((0, 1),)
            for i, j in groups:
                rank = int(ranks[i])
                if rank in index:
                    index[rank].append(places[i:j])
                else:
                    index[rank] = [places[i:j]]
                    heapq.heappush(heap, rank)

        note(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            left, right, made = self._merge[rank]
            lists = index.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            places = places[sym[places] == left]
            places = places[sym[after[places]] == right]
            if left == right and len(places) > 1:  # of a run such as aaa, every second position
                kept, last = [], -1
                for i, j in zip(places.tolist(), after[places].tolist(), strict=True):
                    if i != last:
                        kept.append(i)
                        last = j
                places = np.array(kept)
            if not len(places):
                continue
            gone = after[places]
            sym[places] = made
            sym[gone] = -2
            nxt = after[gone]  # a word ends with a mark, so there is always a next position
            after[places] = nxt
            before[nxt] = places
            prev = before[places]
            note(np.concatenate([prev[prev >= 0], places]))
        keep = sym >= 0
        ids = sym[keep].astype("<u4").tobytes()
        stops = (np.cumsum(keep)[ends] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def _fill(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of every pre-token in ``wanted``; unknown ones go through the index together."""
        known, new = self._words.part(wanted)
        if new:
            made = dict(zip(new, self._merge_all(new), strict=True))
            self._words.add(made)
            known.update(made)
        return known

    # -- texts ---------------------------------------------------------------

    def _segments(self, text: str) -> list[str]:
        return [s for s in self._split.split(text) if s] if self._split and any(a in text for a in self.added) else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        gc.disable()  # millions of live strings, no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        jobs = []  # of each text: its segments, each with its lines of words, or with pre-tokens
        firsts: set[str] = set()
        spaced: set[str] = set()
        rest: set[str] = set()
        for text in texts:
            if not text.isascii():
                self._learn_classes(text)
            job = []
            for segment in self._segments(text):
                if segment in self.added:
                    job.append((0, segment))
                elif segment and _crowded(segment):
                    rest.update(tokens := self._pretokens(segment))
                    job.append((2, tokens))
                elif segment:  # single blanks and line ends only: no pre-token reaches over them
                    lines = []
                    for line in segment.split("\n"):
                        first, _, more = line.partition(" ")
                        firsts.add(first)
                        spaced.update(more := more.split(" ") if more else ())
                        lines.append((first, more))
                    job.append((1, lines))
            jobs.append(job)
        plain_ids, more = self._plain.part(firsts)
        spaced_ids, most = self._spaced.part(spaced)
        new = {w: self._word_pretokens("", w) for w in more}, {w: self._word_pretokens(" ", w) for w in most}
        for table in new:
            for tokens in table.values():
                rest.update(tokens)
        words = self._fill(rest)
        for table, ids, cache in zip(new, (plain_ids, spaced_ids), (self._plain, self._spaced), strict=True):
            made = {w: words[t[0]] if len(t) == 1 else b"".join([words[x] for x in t]) for w, t in table.items()}
            cache.add(made)
            ids.update(made)
        get = spaced_ids.__getitem__
        out = []
        for job in jobs:
            ids = []
            for kind, what in job:
                if kind == 0:
                    ids.append(self._pack([self.added[what]]))
                elif kind == 2:
                    ids += map(words.__getitem__, what)
                else:
                    for first, more in what:
                        ids.append(plain_ids[first])
                        ids += map(get, more)
                        ids.append(self._newline)
                    ids.pop()
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """The vocabulary, read once in a Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and where asked for
    ids (array of int) and decoded (string).  Null and empty texts have no ids:
    n_tokens 0 and the digests of empty strings.  A null doc_id stays null,
    repeated rows give repeated rows, an empty table an empty table; other
    columns of ``docs`` are not looked at.  Rows stay in their partitions.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        for whole in batches:
            for batch in sub_batches(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = bpe.encode(texts)
                back = [bpe.decode(x) for x in ids]
                out = {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                }
                if keep_ids:
                    out["ids"] = pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32()))
                if keep_text:
                    out["decoded"] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return text_view(docs, id_col, text_col).mapInArrow(lean(run), schema)


def decode_ids(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of an array of ids (null array: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.asarray(x, dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(texts, pa.string())})

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(lean(run), "doc_id long, decoded string")
