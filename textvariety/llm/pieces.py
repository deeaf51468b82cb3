"""SentencePiece BPE by a merge-type prefix table.

The library's BPE merges, anywhere in the text, the adjacent pair whose joined
string is a piece of highest score, the leftmost one on ties, until none is
left; symbols that are no piece become their UTF-8 bytes. Here:

* Normalising: a text that is not empty gets a leading `▁` and every blank
  (U+0020) becomes `▁` (the model's settings: identity rules, dummy prefix,
  blanks escaped, no other changes; checked when the model is read).
* No piece holds `▁` after its first character but the runs of `▁` alone, and
  those have the lowest score. So a text splits, before every `▁`, into
  segments that never merge with one another, and the runs of lone `▁` tokens
  merge last: leftmost first, which a stack does in one pass.
* A segment is encoded by a prefix table: for every prefix the last token of
  its encoding is unique, and it is the piece t ending there (an Aho-Corasick
  automaton lists them) that is compatible with the last token of what comes
  before t, compatible meaning that the pair, joined and encoded, gives that
  very pair again. The ids are then read backwards from the end.
  Compatibility is decided by encoding the joined pair (at most 32 characters)
  plainly, once for every pair a worker meets.
* A table depends on what stands before only, so the new segments of some rows
  are taken in sorted order, each going on where it parts from the one before,
  and a last mark that ends no longer piece is a token after the rest's table.

Spark's part: the documents are read where they lie, encoded in Arrow batches
and never shuffled; the digests are DataFrame functions. Each Python worker
keeps the automaton, the pairs it met, at most PAIRS, and two
generations of segments, at most CACHED of each (and what ROWS rows add).

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded each; very long texts and segments are handled like short ones (the
table is linear in a segment's length); columns beside `doc_id` and `text`,
also with clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.llm.chunks import TAILS, give_back, of_worker
from textvariety.llm.common import pick

# Fixed by the library's format: the blank mark and the kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED = 200_000  # segments of a generation
PAIRS = 500_000  # pairs a worker keeps before it starts afresh
ROWS = 1000  # rows whose texts are Python strings at a time


class PieceModel:
    """Pieces, their order of merging and the prefix-table encoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as spec  # the file's format only

        proto = spec.ModelProto()
        with open(path, "rb") as handle:
            proto.ParseFromString(handle.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != spec.TrainerSpec.BPE:
            raise ValueError("not a BPE model")
        if norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces:
            raise ValueError("only identity normalisation with escaped blanks is supported")
        if trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("blanks must lead pieces and bytes must be a fallback")
        self.dummy = norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.pieces: list[str] = []
        scored = []
        for i, p in enumerate(proto.pieces):
            self.pieces.append(p.piece)
            if p.type == NORMAL:
                self.ids[p.piece] = i
                scored.append((-p.score, i, p.piece))
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
        self.is_byte = {self.byte_ids[b]: b for b in range(256)}
        runs = {p for p in self.ids if p and set(p) == {MARK}}
        for p in self.ids:
            if p not in runs and MARK in p[1:]:
                raise ValueError(f"piece {p!r} holds a blank inside")
        lowest = min(-s for s, _, p in scored if p in runs) if runs else None
        if runs and any(-s <= lowest for s, _, p in scored if p not in runs):
            raise ValueError("runs of blanks must merge last")
        # Merge order of all other pieces; their scores are distinct.
        order = sorted((s, i, p) for s, i, p in scored if p not in runs or p == MARK)
        self.rank = {p: r for r, (_, _, p) in enumerate(order)}
        self.run_sizes = {len(p) for p in runs}
        self.mark_id = self.ids.get(MARK)
        import ahocorasick  # noqa: PLC0415  (workers import it once)

        self.size = len(self.pieces)
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if len(piece) > 1:
                self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.rank), default=1)
        # The last two characters of all pieces that have as many.
        self._ends = {p[-2:] for p in self.rank if len(p) > 1}
        self._segments: dict[str, list[int]] = {}
        # Ids, as bytes, of the parts that follow a blank, and of those before.
        self._led: dict[str, bytes] = {}
        self._led_before: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._codes: dict[str, int] = {}
        self._tails = {c: array("i", self._spelt([self._code(c)])).tobytes() for c in TAILS}

    # --- plain BPE of short strings: the meaning of compatibility ---

    def plain(self, text: str) -> list[str]:
        """BPE of a short string: best-ranked pair first, leftmost on ties."""
        symbols = list(text)
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    # Tokens as codes: a piece's id, or len(pieces) + the code point of a
    # character that is no piece.

    def _text(self, code: int) -> str:
        return self.pieces[code] if code < self.size else chr(code - self.size)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pair, joined and encoded, gives itself again."""
        key = left << 22 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            a, b = self._text(left), self._text(right)
            known = self._pairs[key] = self.plain(a + b) == [a, b]
        return known

    def whole(self, code: int) -> bool:
        """Whether a piece is what its own string encodes to."""
        known = self._whole.get(code)
        if known is None:
            text = self._text(code)
            known = self._whole[code] = self.plain(text) == [text]
        return known

    # --- the prefix table ---

    def segment(self, text: str) -> list[int]:
        """Token codes of a segment, by the last token of every prefix."""
        return next(self.segments([text]))

    def segments(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Token codes of each segment; a table goes on from the prefix that its
        segment shares with the one before."""
        last = [0]  # code of the last token of each prefix
        width = [0]  # its length
        before = ""
        for text in texts:
            if text in self.rank and self.whole(self.ids[text]):
                yield [self.ids[text]]
                continue
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], width[shared + 1 :]
            before = text
            self._go_on(text, last, width)
            out, i = [], len(text)
            while i > 0:
                out.append(last[i])
                i -= width[i]
            yield out[::-1]

    def _go_on(self, text: str, last: list[int], width: list[int]) -> None:
        """Fill the table of a segment up from the prefixes it holds."""
        shared, size, codes = len(last) - 1, self.size, self._codes
        pairs, wholes = self._pairs, self._whole
        found = self.automaton.iter(text, max(0, shared + 1 - self.longest))
        matches = [m for m in found if m[0] >= shared]
        at, count = 0, len(matches)
        for i in range(shared + 1, len(text) + 1):
            found = -1
            while at < count and matches[at][0] + 1 == i:
                if found < 0:
                    code, length = matches[at][1]
                    j = i - length
                    if j == 0:
                        ok = wholes.get(code)
                        ok = self.whole(code) if ok is None else ok
                    else:
                        ok = pairs.get(last[j] << 22 | code)
                        ok = self.compatible(last[j], code) if ok is None else ok
                    if ok:
                        found, wide = code, length
                at += 1
            if found < 0:  # the single character is always a candidate
                c = text[i - 1]
                code = codes.get(c)
                if code is None:
                    code = codes[c] = self._code(c)
                if i == 1:
                    found, wide = code, 1
                else:
                    ok = pairs.get(last[i - 1] << 22 | code)
                    if ok if ok is not None else self.compatible(last[i - 1], code):
                        found, wide = code, 1
            if found < 0:  # cannot happen for BPE; kept as a loud guard
                raise RuntimeError(f"no last token at {i} of {text[:40]!r}")
            last.append(found)
            width.append(wide)

    def segment_ids(self, text: str) -> list[int]:
        ids = self._segments.get(text)
        if ids is None:
            if len(self._segments) > CACHED:
                self._segments.clear()
            ids = self._segments[text] = self._ids_of(text)
        return ids

    def _ids_of(self, text: str) -> list[int]:
        """Ids of a segment, characters that are no piece as their bytes."""
        return self._spelt(self.segment(text))

    def _spelt(self, codes: list[int]) -> list[int]:
        size = self.size
        if max(codes) < size:
            return codes
        ids = []
        for code in codes:
            if code < size:
                ids.append(code)
            else:
                ids.extend(self.byte_ids[b] for b in chr(code - size).encode("utf-8"))
        return ids

    def blanks(self, count: int) -> list[int]:
        """Ids of a run of `count` lone blanks, merged leftmost first."""
        stack: list[int] = []
        for _ in range(count):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.run_sizes:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.ids[MARK * k] for k in stack]

    def encode(self, text: str) -> list[int]:
        (raw,) = self.encode_all([text])
        return array("i", raw).tolist()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, 32-bit integers as bytes."""
        # Blanks only: the parts between blanks, each led by a mark.
        cut = [t.split(" ") if t and self.dummy and MARK not in t else [] for t in texts]
        self._learn(set().union(*cut))
        get = self._led.__getitem__
        for text, parts in zip(texts, cut):
            if not text:
                yield b""
            elif not parts:
                yield array("i", self._encode_marked(text)).tobytes()
            else:
                raw = b"".join(map(get, parts))
                # Lone marks meet only after a blank that follows the start or a blank.
                if text[0] == " " or "  " in text:
                    raw = array("i", self._merge_blanks(array("i", raw).tolist())).tobytes()
                yield raw

    def _learn(self, parts: set[str]) -> None:
        """Encode the parts that are not known yet."""
        if len(self._led) > CACHED:
            self._led, self._led_before = {}, self._led
        known, before, ends = self._led, self._led_before, self._ends
        new = {p for p in parts if p not in known}
        known.update((p, before[p]) for p in new if p in before)
        new = [p for p in new if p not in known]
        marked = [p for p in new if p[-1:] in self._tails and len(p) > 1 and p[-2:] not in ends]
        words = {p[:-1] for p in marked}
        known.update((p, before[p]) for p in words if p in before)
        asked = sorted(p for p in words.union(set(new).difference(marked)) if p not in known)
        for p, codes in zip(asked, self.segments(MARK + p for p in asked)):
            known[p] = array("i", self._spelt(codes)).tobytes()
        for p in marked:
            known[p] = known[p[:-1]] + self._tails[p[-1]]

    def _code(self, character: str) -> int:
        return self.ids[character] if character in self.rank else self.size + ord(character)

    def _encode_marked(self, text: str) -> list[int]:
        marked = (MARK if self.dummy else "") + text.replace(" ", MARK)
        parts = marked.split(MARK)
        ids = []
        if parts[0]:
            ids.extend(self.segment_ids(parts[0]))
        for p in parts[1:]:
            ids.extend(self.segment_ids(MARK + p))
        return self._merge_blanks(ids)

    def _merge_blanks(self, ids: list[int]) -> list[int]:
        mark = self.mark_id
        if mark is None or not self.run_sizes or not self._lone_pairs(ids, mark):
            return ids
        out, i = [], 0
        while i < len(ids):
            if ids[i] != mark:
                out.append(ids[i])
                i += 1
                continue
            j = i
            while j < len(ids) and ids[j] == mark:
                j += 1
            out.extend(self.blanks(j - i))
            i = j
        return out

    @staticmethod
    def _lone_pairs(ids: list[int], mark: int) -> bool:
        """Whether two lone blanks stand next to each other."""
        if len(ids) < 2:
            return False
        a = np.asarray(ids)
        return bool(np.any((a[1:] == mark) & (a[:-1] == mark)))

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of what the library's decode gives for `ids`."""
        table = self._table
        raw = b"".join([table[i] for i in ids])
        if self.dummy and ids and self.pieces[ids[0]].startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace").encode("utf-8")

    @property
    def _table(self) -> list[bytes]:
        table = getattr(self, "_bytes", None)
        if table is None:
            table = [p.replace(MARK, " ").encode("utf-8") for p in self.pieces]
            for b, i in enumerate(self.byte_ids):
                table[i] = bytes([b])
            self._bytes = table
        return table

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8")


def _encode(batches, path: str, keep: list[str]):
    model = of_worker(f"pieces:{path}", lambda: PieceModel(path))
    table = model._table
    lengths = np.array([len(b) for b in table], np.int64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    pool = np.frombuffer(b"".join(table), np.uint8)
    dropped = np.array(
        [model.dummy and p.startswith(MARK) for p in model.pieces], bool
    )
    # A few rows at a time, for what Python and the gathering make of them.
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
        lists = list(model.encode_all([t or "" for t in batch.column("text").to_pylist()]))
        sizes = np.cumsum([0] + [len(x) // 4 for x in lists]).astype(np.int32)
        flat = np.frombuffer(b"".join(lists), np.int32)
        # Decoded bytes of all rows at once: each id's bytes gathered from a pool.
        size = lengths[flat]
        ends = np.cumsum(size)
        gather = np.repeat(starts[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = pool[gather].tobytes()
        row_ends = np.r_[0, ends][sizes]
        digests = []
        for r in range(len(lists)):
            a, b = int(row_ends[r]), int(row_ends[r + 1])
            if b > a and dropped[flat[sizes[r]]] and raw[a : a + 1] == b" ":
                a += 1
            # As the library decodes: a broken byte sequence becomes U+FFFD.
            text = raw[a:b].decode("utf-8", "replace").encode("utf-8")
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep),
             pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
             pa.array(digests, pa.string())],
            [*keep, "ids", "decoded_sha256"],
        )
    give_back()


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The columns `keep` of every row, `ids` (int array) of its whole text and
    `decoded_sha256` of what the ids decode to. `path`: a model file every
    executor can read."""
    rows = pick(docs, *dict.fromkeys((*keep, "text")))
    whole = rows.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in whole.drop("text").dtypes)
    return whole.mapInArrow(
        partial(_encode, path=path, keep=list(keep)),
        f"{schema}, ids array<int>, decoded_sha256 string",
    )


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode`'s rows."""
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(told, 256).alias("ids_sha256"),
        "decoded_sha256",
    )
