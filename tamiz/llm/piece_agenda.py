"""SentencePiece encoding and decoding with an agenda of adjacent symbol pairs.

A text is the dummy prefix and its characters, blanks shown as U+2581. All pairs of neighbouring symbols whose
concatenation is a piece stand in an agenda ordered by score, then by place; the best is merged and the pairs that
its result forms with its neighbours enter. What no piece covers falls back to bytes. Two characters that stand side
by side in no piece can never meet in a merge: texts are cut before each run of blanks or line ends, and long words
at all such pairs, and what lies between is merged on its own. The ids of short words are remembered, up to a bound of entries.

Every word that was merged is checked against the ``sentencepiece`` library, all new ones of an Arrow batch in one call
(``check="words"``); ``check="texts"`` compares the ids and the decoded form of every whole text instead. A difference stops the job; the
library's answer never takes the place of the agenda's. The model file (0.5 MB) is read by the driver and broadcast.

Defined results: null text is empty text, which has the begin and end ids only and decodes to empty text; rows are encoded one by
one, so repeated rows agree; other columns are not read; an empty table gives an empty one. A text of any length is encoded
whole; its working memory grows with its longest run of joined characters.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Entries after which the table of remembered words starts anew.
REMEMBERED = 1_000_000
#: Longer words are cut at pairs that no piece holds, and aren't remembered.
LONG_WORD = 48
#: Words after which the library is asked, however long the batch.
CHECK_EVERY = 20_000
NEVER = 1 << 62

# Bytes that are no UTF-8 decode to one replacement character each.
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


class PieceAgenda:
    """One merge-type vocabulary with byte fallback, identity normalisation and dummy prefix."""

    words = re.compile(f"\n+[^ {BLANK}\n]*|[ {BLANK}]+[^ {BLANK}\n]*")

    def __init__(self, model: bytes, check: str = "words"):
        if check not in ("words", "texts"):
            raise ValueError(f"unknown check {check}")
        lib = self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check, self.begin, self.end = check, lib.bos_id(), lib.eos_id()
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(len(pieces))]
        self.id = {p: i for i, p in enumerate(pieces) if not special[i]}
        #: Pieces of equal score have equal rank, so that the leftmost comes first.
        place = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in self.id.values()}, reverse=True))}
        self.rank = {p: place[lib.get_score(i)] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        if len(self.byte) < 256 or BLANK not in self.id or any(lib.is_unused(i) for i in self.id.values()):
            raise ValueError("the model needs byte fallback, a blank piece and no unused pieces")
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(pair[1] == BLANK != pair[0] or "\n" in pair for pair in self.joined):
            raise ValueError("a piece holds a blank after another character, or a line end, so words can't be merged on their own")
        unknown = " ⁇ "
        self.shown = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else (unknown if lib.is_unknown(i) else "" if lib.is_control(i) else p.replace(BLANK, " ")).encode() for i, p in enumerate(pieces)]
        self.control = {i for i in range(len(pieces)) if lib.is_control(i)}
        #: left id << 20 | right id -> rank << 20 | id of the two together.
        self.pair = {self.id[p[:k]] << 20 | self.id[p[k:]]: self.rank[p] << 20 | i for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self.letter = {p: i for p, i in self.id.items() if len(p) == 1}.get
        self.line_end = self.id.get("\n", self.byte[10])
        self.blank_first = {i for p, i in self.id.items() if p.startswith(BLANK)}
        self.known: dict[str, bytes] = {}
        self.unchecked: dict[str, bytes] = {}

    def _merged(self, part: str) -> list[int]:
        """The ids that are left when the agenda is empty."""
        if len(part) <= LONG_WORD and None not in (ids := list(map(self.letter, part))):
            return self._merged_short(ids)
        out: list[int] = []
        for x in self._merged_long(part):
            i = self.id.get(x)
            out += [self.byte[b] for b in x.encode()] if i is None else [i]
        return out

    def _merged_short(self, ids: list[int]) -> list[int]:
        """The agenda as a list in order of place, its best found by a scan."""
        get = self.pair.get
        agenda = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            k = agenda.index(best)
            ids[k] = now = best & 0xFFFFF
            del ids[k + 1], agenda[k]
            if k:
                agenda[k - 1] = get(ids[k - 1] << 20 | now, NEVER)
            if k < len(agenda):
                agenda[k] = get(now << 20 | ids[k + 1], NEVER)
        return ids

    def _merged_long(self, part: str) -> list[str]:
        """The agenda as a heap; a pair whose symbols have changed since is passed over."""
        n, rank = len(part), self.rank.get
        symbol: list[str] = list(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(s, k, two) for k in range(n - 1) if (s := rank(two := part[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, k, two = heapq.heappop(agenda)
            r = right[k]
            if not symbol[k] or r < 0 or symbol[k] + symbol[r] != two:
                continue
            symbol[k], symbol[r], after = two, "", right[r]
            right[k] = after
            if after >= 0:
                left[after] = k
                if (s := rank(new := two + symbol[after])) is not None:
                    heapq.heappush(agenda, (s, k, new))
            if (before := left[k]) >= 0 and (s := rank(new := symbol[before] + two)) is not None:
                heapq.heappush(agenda, (s, before, new))
        return [x for x in symbol if x]

    def _parts(self, word: str) -> Iterator[str]:
        begin = 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.joined:
                yield word[begin:k]
                begin = k
        yield word[begin:]

    def word(self, word: str) -> bytes:
        """The ids of a run of blanks or line ends and what follows it, as little-endian unsigned 32-bit integers."""
        tail = word.lstrip("\n")
        ends, word = [self.line_end] * (len(word) - len(tail)), tail.replace(" ", BLANK)
        ids = self._merged(word) if len(word) <= LONG_WORD else [i for part in self._parts(word) for i in self._merged(part)]
        return pack(f"<{len(ends) + len(ids)}I", *ends, *ids)

    def _new(self, word: str) -> bytes:
        """Of a word that isn't remembered, or has come a second time since."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.word(word)
            if len(word) <= LONG_WORD:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = ids
            if self.check == "words":
                self.unchecked[word] = ids
                if len(self.unchecked) >= CHECK_EVERY:
                    self.check_words()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, between the begin and end ids."""
        words = self.words.findall(" " + text) if text else []
        out = list(map(self.known.get, words))
        if None in out:
            out = [self._new(word) if ids is None else ids for word, ids in zip(words, out)]
        return pack("<I", self.begin) + b"".join(out) + pack("<I", self.end)

    def decode(self, ids: bytes) -> str:
        """Without the dummy prefix's blank; control ids show nothing."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        first = next((i for i in numbers if i not in self.control), None)
        raw = b"".join(map(self.shown.__getitem__, numbers))
        if first in self.blank_first:
            raw = raw[1:]
        return raw.decode("utf-8", "each-byte")

    def check_words(self) -> None:
        """Compares what was merged since the last call with the library."""
        # The library puts the dummy prefix before a word itself, but for one that is nothing else.
        blank = pack("<I", self.id[BLANK])
        asked = [w for w in self.unchecked if w not in (" ", BLANK)]
        theirs = self.lib.encode([w if w[0] == "\n" else w[1:] for w in asked], num_threads=1)
        for w, ids in zip(asked, theirs, strict=True):
            own = self.unchecked[w]
            if pack(f"<{len(ids)}I", *ids) != (blank + own if w[0] == "\n" else own):
                raise RuntimeError(f"the library encodes {w[:200]!r} otherwise")
        self.unchecked.clear()

    def check_texts(self, texts: list[str], ids: list[bytes], decoded: list[str]) -> None:
        theirs = self.lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        for text, own, back, other, shown in zip(texts, ids, decoded, theirs, self.lib.decode(theirs, num_threads=1), strict=True):
            if np.array(other, "<u4").tobytes() != own or shown != back:
                raise RuntimeError(f"the library encodes or decodes {text[:200]!r} otherwise")


_loaded: dict[tuple[bytes, str], PieceAgenda] = {}


def _parsed(model: bytes, check: str) -> PieceAgenda:
    """The vocabulary, parsed once in each Python worker."""
    key = (hashlib.sha256(model).digest(), check)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceAgenda(model, check)
    return _loaded[key]


def _coder(shared, check: str, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = _parsed(shared.value, check)
        for batch in batches:
            n, ids, back = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                got = agenda.encode(text)
                decoded = agenda.decode(got)
                if check == "texts":
                    agenda.check_texts([text], [got], [decoded])
                n.append(len(got) // 4)
                ids.append(hashlib.sha256(got).hexdigest() if digests else np.frombuffer(got, "<u4").astype(np.int32).tolist())
                back.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            agenda.check_words()
            kind = pa.string() if digests else pa.list_(pa.int32())
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(back, pa.string())], names=names)

    return code


def piece_round_trip(docs: DataFrame, model: str, digests: bool = False, check: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and the decoded text, or the SHA-256 of both."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return rows.mapInArrow(_coder(shared, check, digests), schema)
