"""Byte-pair encoding of whole texts with a public vocabulary, and decoding back to its pieces.

A word's adjacent pairs are the leaves of a segment tree ordered by (rank, position), so the root is the leftmost pair
of lowest rank. Merging it changes three leaves, each by an update along one path, until no pair can be merged. Short
words are merged in step, a row of trees for each length class; long words have a tree of their own.

Vocabulary files are read where they lie, by path, on every machine: a JSON file whose pipeline is NFC, white space to
one blank, lower case, the split pattern of the file, byte-level characters, and a suffix on a word's last character.

Defined results: a null or empty text has no ids and decodes to an empty text. Special tokens written out in a text
are taken as such, before anything else. Words of any length are encoded whole. Repeated rows give equal results; an
empty table gives an empty one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pick, small_batches, type_of

#: Words kept with their ids in each worker; when it is full, it starts anew.
CACHE = 400_000
#: Characters of the texts whose words are looked up together, and ids decoded at a time.
TOGETHER, STRETCH = 1 << 22, 1 << 16
#: Symbols of the longest word that is merged in step with others.
SHORT = 64
NONE = np.int64(1) << 62
#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairTree:
    """The smallest (rank, position) over the adjacent pairs of one word."""

    def __init__(self, keys: list[int]) -> None:
        self.width = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = [NONE] * self.width + keys + [NONE] * (self.width - len(keys))
        for i in range(self.width - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    @property
    def root(self) -> int:
        return self.node[1]

    def put(self, leaf: int, key: int) -> None:
        node, i = self.node, leaf + self.width
        node[i] = key
        while i > 1:
            i >>= 1
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                break
            node[i] = low


class Vocabulary:
    """The tables of one vocabulary file, and the words it has encoded last."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, ids = found["model"], found["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*ids.values(), *(t["id"] for t in found["added_tokens"])]))
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        letters = byte_characters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + suffix] for c in letters]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        keys = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = (np.array([v[i] for v in self.rank.values()], dtype=np.int64)[order] for i in (0, 1))
        self.pieces = regex.compile(found["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE)).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.white = regex.compile(f"[{WHITE}]+")
        self.inner_of, self.last_of = np.array(self.inner, dtype=np.int64), np.array(self.last, dtype=np.int64)
        #: Ids as four bytes each: of words, and of what stands between white space.
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    # One word on its own.

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols of a word after all merges."""
        n = len(symbols)
        if n < 2:
            return symbols
        symbols, rank = list(symbols), self.rank
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def key(i: int) -> int:
            j = after[i] if i >= 0 else -1
            found = rank.get((symbols[i], symbols[j])) if j >= 0 else None
            return found[0] << 32 | i if found else NONE

        tree = PairTree([key(i) for i in range(n - 1)])
        while tree.root != NONE:
            i = int(tree.root) & 0xFFFFFFFF
            j = after[i]
            symbols[i] = rank[symbols[i], symbols[j]][1]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if j < n - 1:
                tree.put(j, NONE)
            tree.put(i, key(i)) if i < n - 1 else None
            if before[i] >= 0:
                tree.put(before[i], key(before[i]))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    # Many short words in step.

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rank, made)`` of each pair, rank -1 where it can't be merged."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = (self.keys[at] == want) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], -1), self.made[at]

    def merged_together(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of at most ``width`` symbols, a power of two: all their ids, and how many each has."""
        n = len(lengths)
        rows = np.arange(n)
        # Place 0 stands before every word, place width + 1 behind it; both hold no symbol.
        symbols = np.full((n, width + 2), -1, dtype=np.int64)
        inside = np.arange(1, width + 1)[None, :] <= lengths[:, None]
        symbols[:, 1 : width + 1][inside] = flat[(starts[:, None] + np.arange(width)[None, :])[inside]]
        after = np.tile(np.arange(1, width + 3), (n, 1))
        after[:, width + 1] = width + 1
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        before[:, 0] = 0
        leaves = 2 * width  # room for places 0 to width + 1
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        rank, _ = self._found(symbols[:, :-1], symbols[:, 1:])
        places = np.arange(width + 1, dtype=np.int64)
        tree[:, leaves : leaves + width + 1] = np.where(rank >= 0, rank << 8 | places, NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(r: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
            node = leaf + leaves
            tree[r, node] = key
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def paired(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            rank, _ = self._found(symbols[r, i], symbols[r, after[r, i]])
            return np.where(rank >= 0, rank << 8 | i, NONE)

        active = rows[tree[:, 1] != NONE]
        while len(active):
            i = tree[active, 1] & 0xFF
            j = after[active, i]
            _, made = self._found(symbols[active, i], symbols[active, j])
            symbols[active, i] = made
            symbols[active, j] = -2
            behind = after[active, j]
            after[active, i] = behind
            before[active, behind] = i
            put(active, j, NONE)
            put(active, i, paired(active, i))
            ahead = before[active, i]
            put(active, ahead, paired(active, ahead))
            active = active[tree[active, 1] != NONE]
        kept = symbols >= 0
        return symbols[kept].astype(np.int32), kept.sum(axis=1)

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes each."""
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data])
        codes = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner_of[codes]
        symbols[ends - 1] = self.last_of[codes[ends - 1]]
        out = [b""] * len(words)
        width = 2
        for k in np.flatnonzero(lengths > SHORT).tolist():
            out[k] = np.array(self.merged(symbols[ends[k] - lengths[k] : ends[k]].tolist()), np.int32).tobytes()
        while width <= SHORT:
            members = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            for start in range(0, len(members), 4096):
                part = members[start : start + 4096]
                ids, counts = self.merged_together(symbols, ends[part] - lengths[part], lengths[part], width)
                ids, at = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
                for k, x, y in zip(part.tolist(), at, at[1:], strict=False):
                    out[k] = ids[x:y]
            width *= 2
        return out

    # Texts.

    def _runs(self, text: str) -> list[str]:
        """The parts of a text between white space, normalised; the split pattern never crosses them."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case is taken character by character: a sigma that ends a word is like any other.
        text = text.replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.white.split(text) if x]
        return text.split()

    def _pieces(self, run: str) -> list[str]:
        """What the split pattern finds; a word, with one character behind it or none, needs no search."""
        if run.isalpha():
            return [run]
        return [run[:-1], run[-1]] if run[:-1].isalpha() else self.pieces(run)

    def _learn(self, runs: set[str]) -> None:
        new = [r for r in runs if r not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(runs)
        pieces = [self._pieces(r) for r in new]
        unknown = list({p for own in pieces for p in own if p not in self.words})
        if len(self.words) + len(unknown) > CACHE:
            self.words.clear()
            unknown = list({p for own in pieces for p in own})
        self.words.update(zip(unknown, self.word_ids(unknown), strict=True)) if unknown else None
        look = self.words.__getitem__
        self.known.update((r, look(own[0]) if len(own) == 1 else b"".join(map(look, own))) for r, own in zip(new, pieces, strict=True))

    def _parts(self, text: str) -> list[list[str] | int]:
        """Runs of the text between its special tokens, and their ids."""
        own, at = [], 0
        if any(s in text for s in self.special):
            for m in self.specials.finditer(text):
                own += [self._runs(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
        return [*own, self._runs(text[at:])]

    def _joined(self, parts: list[list[list[str] | int]], need: set[str]) -> list[np.ndarray]:
        self._learn(need)
        look = self.known.__getitem__
        return [np.frombuffer(b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(look, p)) for p in own]),
                              np.dtype("<i4")) for own in parts]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out, parts, need, held = [], [], set(), 0
        for text in texts:
            own = self._parts(text or "")
            parts.append(own)
            need.update(chain.from_iterable(p for p in own if not isinstance(p, int)))
            held += len(text or "")
            # No more runs at a time than the cache holds, and no more text than this, unless one text has more.
            if len(need) >= CACHE // 4 or held >= TOGETHER:
                out += self._joined(parts, need)
                parts, need, held = [], set(), 0
        return out + self._joined(parts, need)

    def decode(self, ids: np.ndarray) -> str:
        """The pieces joined by blanks: the files of this kind name no decoder. Ids become objects a stretch at a time."""
        look = self.tokens.__getitem__
        return " ".join(" ".join(map(look, ids[i : i + STRETCH].tolist())) for i in range(0, len(ids), STRETCH))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    docs = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            found = words.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, ids array<int>")


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the text that the ids stand for."""
    path = path or default_path()
    encodings = pick(encodings, "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = pa.array([words.decode(ids.values.to_numpy()) if ids.is_valid else "" for ids in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "decoded"])

    return encodings.mapInArrow(run, f"doc_id {type_of(encodings, 'doc_id')}, ids array<int>, decoded string")


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``decoded(encoded(docs))`` by one worker for each task, which reads the vocabulary once."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    docs = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            found = words.encode(batch.column(1).to_pylist())
            texts = pa.array([words.decode(ids) for ids in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found), texts], ["doc_id", "ids", "decoded"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, ids array<int>, decoded string")


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))


def digests(decodings: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    return decodings.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
