"""BPE encoding and decoding with forced boundaries.

A byte pair that stands next to each other inside no vocabulary token can never be merged across, so a
cut between its bytes is certain. Words are split at such cuts; the fragments are encoded independently
and their ids concatenated. A fragment's ids are remembered for the rest of the batch stream, up to a
bound of entries, since the same fragments return often.

The vocabulary is a file of the ``tokenizers`` library (BPE with an end-of-word suffix). The driver reads it
and broadcasts its text (about 2 MB, fixed by the file); tasks parse it once per Python worker. Texts are
encoded as that library does with ``add_special_tokens=False``: special tokens are cut out first; the rest is
brought to NFC, lower-cased character by character and split by the file's pattern.

Defined results: null text is empty text; empty text has no ids and decodes to empty text; rows are encoded
one by one, so repeated rows agree; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries after which the table of remembered pieces starts anew.
REMEMBERED = 400_000
#: Fragments of more bytes are merged with a heap.
LONG_FRAGMENT = 48
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters, spare = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return letters


class ForcedBpe:
    """One vocabulary, its certain cuts and its remembered pieces."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        #: left id << 20 | right id -> rank << 20 | merged id
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        byte_of = {c: b for b, c in enumerate(letters)}
        #: joined[a * 256 + b]: bytes a and b stand side by side inside some token.
        self.joined = bytearray(65536)
        for t in vocab:
            t = t.removesuffix(self.suffix) if len(t) > len(self.suffix) else t
            b = [byte_of[c] for c in t if c in byte_of]
            for x, y in zip(b, b[1:]):
                self.joined[x * 256 + y] = 1
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _fragment(self, raw: bytes, final: bool) -> list[int]:
        ids = [self.inner[b] for b in raw]
        if final:
            ids[-1] = self.last[raw[-1]]
        return self._merge_long(ids) if len(ids) > LONG_FRAGMENT else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merge.get
        ranks = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            ids[k] = best & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], NEVER)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merge.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(best, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (best := get(a << 20 | b, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            r = right[k]
            if not alive[k] or r < 0 or ids[k] != a or ids[r] != b:
                continue
            ids[k], alive[r], right[k] = best & 0xFFFFF, False, right[r]
            if right[r] >= 0:
                left[right[r]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (then := get(ids[x] << 20 | ids[y], NEVER)) != NEVER:
                    heapq.heappush(heap, (then, x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, alive) if ok]

    def piece(self, word: str) -> bytes:
        """The ids of one piece, as little-endian unsigned 32-bit integers."""
        raw, joined, ids, begin = word.encode(), self.joined, [], 0
        for k in range(1, len(raw)):
            if not joined[raw[k - 1] * 256 + raw[k]]:
                ids += self._fragment(raw[begin:k], False)
                begin = k
        ids += self._fragment(raw[begin:], True)
        return np.array(ids, "<u4").tobytes()

    def _ordinary(self, text: str, out: list[bytes]) -> None:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # Python alone has a rule for the last letter of a word
        known, piece = self.known, self.piece
        for word in self.pieces.findall(text.lower()):
            got = known.get(word)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = piece(word)
                if len(word) <= LONG_FRAGMENT:
                    known[word] = got
            out.append(got)

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        if any(s in text for s in self.special):
            for k, part in enumerate(self.cut_special.split(text)):
                if k % 2:
                    out.append(np.array([self.special[part]], "<u4").tobytes())
                elif part:
                    self._ordinary(part, out)
        else:
            self._ordinary(text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: tokens are joined by spaces."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, ForcedBpe] = {}


def _parsed(file_text: str) -> ForcedBpe:
    """The vocabulary, parsed once in each Python worker."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ForcedBpe(file_text)
    return _loaded[key]


def _coder(shared, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _parsed(shared.value)
        for batch in batches:
            n, ids, back = [], [], []
            for value in batch.column(1):
                got = bpe.encode(value.as_py() or "")
                text = bpe.decode(got)
                n.append(len(got) // 4)
                ids.append(hashlib.sha256(got).hexdigest() if digests else np.frombuffer(got, "<u4").astype(np.int32).tolist())
                back.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            kind = pa.string() if digests else pa.list_(pa.int32())
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(back, pa.string())], names=names)

    return code


def bpe_round_trip(docs: DataFrame, vocabulary: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and the decoded text, or the SHA-256 of both."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return rows.mapInArrow(_coder(shared, digests), schema)
