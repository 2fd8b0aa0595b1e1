"""BPE encoding and decoding with a contiguous rank array.

Each short word keeps two parallel lists: its current parts and the merge rank of every
adjacent pair. The minimum rank is found by a scan, one boundary is deleted and only the two
neighbouring ranks are refreshed. Words repeat, so finished words are kept in a bounded map.

Defined results: a null text encodes as the empty text (no ids, empty decoded text); texts of
any length are encoded whole; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, prepare, remembers

#: Fixed value: white space that the vocabulary's normalizer folds.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: A plain word before one of these is one piece, and the mark another.
ENDS = frozenset(".,;:!?")
#: Bits of an id.
ID_BITS = 20
#: Longer words use a heap instead of scans, which would be quadratic in the word.
SHORT_WORD = 256
#: Words remembered per Python worker before the map starts afresh.
MEMORY_WORDS = 800_000
#: Words of a text looked up in one generation of the map.
SLICE = 10_000
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others take code points from 256 upwards in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Ids of the words met; a word that is missing is encoded by the owner, which keeps it."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        return self.encode(word)


class WordBpe:
    """Encoder and decoder of a lower-casing word-end BPE vocabulary in tokenizers' JSON form.

    library: pieces are merged by the tokenizers library's model instead of the rank arrays."""

    def __init__(self, path: str, memory: int = MEMORY_WORDS, library: bool = False) -> None:
        self.memory = memory
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.joint = {a << ID_BITS | b: rank << ID_BITS | new for (a, b), (rank, new) in self.pairs.items()}
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.words: dict[str, bytes] = Words(self.encode_word)
        self.older: dict[str, bytes] = {}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.space = re.compile(f"[{SPACE}]+")
        #: str.split() also parts at these; the vocabulary's white space does not.
        self.odd = re.compile("[\x1c-\x1f]")
        self.pieces: dict[str, list[int]] = {}
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.pattern: str = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
        self.split = regex.compile(self.pattern)
        self.path = path
        self.library = None
        self.model = None
        if library:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path).model
            self.letters = dict(enumerate(letters))

    def merge_short(self, parts: list[int]) -> list[int]:
        """Repeatedly delete the boundary of lowest rank (leftmost on ties) until none is left.

        A rank is held with the id that its pair becomes, so a merge needs no second look."""
        get, shift, mask = self.joint.get, ID_BITS, (1 << ID_BITS) - 1
        ranks = [get(a << shift | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            new = parts[i] = best & mask
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << shift | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = get(new << shift | parts[i + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for very long words, by a heap over a linked list."""
        pairs, n = self.pairs, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (parts[left], parts[right])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], left, *p))
        return [p for p in parts if p >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        if self.model is not None:
            return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        return self.merge_short(parts) if len(parts) <= SHORT_WORD else self.merge_long(parts)

    def newer_pieces(self, word: str) -> list[str]:
        """Pieces of a word with letters that are newer than Python's Unicode tables, or with control
        characters: the library normalizes and splits it."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        normalizer, split = self.library
        return [piece for piece, _ in split.pre_tokenize_str(normalizer.normalize_str(word))]

    def encode_word(self, word: str) -> bytes:
        """Ids of a normalized run without white space, which may hold several pieces,
        as little-endian unsigned 32-bit integers."""
        packed = self.words.get(word) or self.older.get(word)
        if packed is None:
            if word.isascii() and word.isalpha():
                ids = self.encode_piece(word)
                packed = struct.pack(f"<{len(ids)}I", *ids)
            elif word[-1] in ENDS and word[:-1].isalpha() and word.isascii():
                # the word without its mark is a piece, and often known
                packed = self.words[word[:-1]] + self.words[word[-1]]
            else:
                ids, known = [], self.pieces
                pieces = self.split.findall(word) if word.isprintable() else self.newer_pieces(word)
                for piece in pieces:
                    got = known.get(piece)
                    if got is None:
                        got = self.encode_piece(piece)
                        if len(piece) <= SHORT_WORD:
                            known[piece] = got
                    ids += got
                if len(known) >= self.memory // 4:
                    known.clear()
                packed = struct.pack(f"<{len(ids)}I", *ids)
        # words not met for a whole generation are forgotten; frequent ones move on
        if len(self.words) >= self.memory * 3 // 8:
            self.older, self.words = self.words, Words(self.encode_word)
        if len(word) <= SHORT_WORD:
            self.words[word] = packed
        return packed

    def normalized_words(self, text: str) -> list[str]:
        """NFC, white space folded, lower case letter by letter; split at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [w for w in self.space.split(text) if w] if self.odd.search(text) else text.split()

    def parts(self, text: str) -> list[str | int]:
        """Alternately plain stretches and ids of special tokens spelled out in the text."""
        if self.cut is None or "<|" not in text:
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.parts(text or ""):
            if isinstance(part, int):
                out.append(struct.pack("<I", part))
                continue
            words = self.normalized_words(part)
            for k in range(0, len(words), SLICE):
                # a generation may end within a slice
                out += map(self.words.__getitem__, words[k : k + SLICE])
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary file, tokens are joined by one space."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


_loaded: dict[tuple[str, int, bool], WordBpe] = {}
remembers("bpe", _loaded.clear)


def load(path: str, memory: int = MEMORY_WORDS, library: bool = False) -> WordBpe:
    """One encoder per worker process, vocabulary, number of words to remember and way to merge."""
    key = path, memory, library
    if key not in _loaded:
        _loaded[key] = WordBpe(*key)
    return _loaded[key]


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>, if asked for), n_tokens, ids_sha256, decoded_sha256.

    A map without a shuffle; each task holds one vocabulary and a bounded word map."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary)
        names = {i: str(i) for i in bpe.token}
        token = bpe.token
        all_ids, counts, ids_sha, text_sha = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text)
            if with_ids:
                all_ids.append(ids)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            decoded = " ".join([token[i] for i in ids])
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        columns = {"doc_id": batch.column(0)}
        if with_ids:
            columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
        columns |= {
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array(text_sha, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), run, schema)
