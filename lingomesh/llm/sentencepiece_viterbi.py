"""SentencePiece encoding and decoding by streaming Viterbi.

Encoding takes the segmentation of a text into vocabulary pieces with the greatest sum of piece
scores (the unigram reading of the model file; of equal sums up to a position the one whose last piece
starts earlier wins).
The text is read as a stream: scores are kept for as many positions as the longest piece has
characters, back pointers only until all paths that are still alive meet in one boundary; then the
ids before that boundary are final and are handed out.  A character without a piece becomes its
UTF-8 bytes (byte pieces).  No vocabulary piece has a word mark after another character, so all
paths meet at every word mark: a text is fed segment by segment, and a bounded memo keeps what the
stream committed for a segment of up to ``KEPT`` characters, so that it need not be fed again.

Decoding joins pieces, byte pieces as UTF-8, word marks as spaces, without the leading mark that
encoding put there; ``decode(encode(text))`` is the text (``\\u2581`` itself decodes as a space).

Edge cases: null and empty text has no ids and decodes to the empty text; beside the text itself a
text of any length takes memory for its ids, one part of ``PART`` characters and the memo, whose
bound is kept at every insertion.  ``doc_id`` may be null or repeat.  Extra columns are ignored.

Scale: one pass without a shuffle; each task loads the vocabulary once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 1 << 20          # segments; about 170 bytes each
KEPT = 48                 # what longer segments commit is not kept in the memo
PART = 1 << 16            # characters that are cut into segments at a time
FED = 1 << 12             # characters of a segment that are fed at a time


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.special = [m.is_control(i) or m.is_unknown(i) for i in range(n)]
        self.byte_of = [int(p[3:5], 16) if m.is_byte(i) else -1 for i, p in enumerate(self.pieces)]
        self.byte_id = {b: i for i, b in enumerate(self.byte_of) if b >= 0}
        self.known = {p: (m.get_score(i), i) for i, p in enumerate(self.pieces)
                      if not self.special[i] and self.byte_of[i] < 0 and not m.is_unused(i)}
        self.longest = max(map(len, self.known))
        #: every beginning of a piece → (score, id), or nothing for what is no piece itself
        self.prefix = {p[:k]: self.known.get(p[:k]) for p in self.known for k in range(1, len(p) + 1)}
        self.unknown_score = min(s for s, _ in self.known.values()) - UNKNOWN_PENALTY
        self.unknown_id = m.unk_id()
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in self.known)
        #: characters that some piece joins with another; any other is a boundary on both sides
        self.joined = {c for p in self.known if len(p) > 1 for c in p} - {MARK}
        #: what each id decodes to
        self.decoded = [b"" if s else bytes([b]) if b >= 0 else p.replace(MARK, " ").encode()
                        for p, s, b in zip(self.pieces, self.special, self.byte_of)]

    def bytes_of(self, char: str) -> list[int]:
        if len(self.byte_id) < 256:
            return [self.unknown_id]
        return [self.byte_id[b] for b in char.encode()]


class StreamingViterbi:
    """Feed text in parts of any size; each call returns the ids that became final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""                    # from the last final boundary on
        self.score = [0.0]                # best sum up to each position of ``text``; the oldest are dropped
        self.back = [-1]                  # start of the best last piece
        self.piece = [-1]                 # its id, -1 for an unknown character
        self.seen = 0                     # positions whose outgoing pieces are all scored

    def feed(self, part: str) -> list[int]:
        self.text += part
        grow = len(self.text) + 1 - len(self.score)
        self.score += [-np.inf] * grow
        self.back += [-1] * grow
        self.piece += [-1] * grow
        # the pieces from a position are known once the longest of them would fit
        self._advance(max(len(self.text) - self.v.longest + 1, 0))
        return self._commit()

    def finish(self) -> list[int]:
        self._advance(len(self.text))
        ids = self._path(len(self.text))
        self.__init__(self.v)
        return ids

    def _advance(self, to: int) -> None:
        text, score, back, piece, prefix, n = self.text, self.score, self.back, self.piece, self.v.prefix, len(self.text)
        for i in range(self.seen, to):
            here, alone = score[i], True
            for j in range(i + 1, n + 1):
                hit = prefix.get(text[i:j], 0)
                if hit == 0:                      # no piece begins like this
                    break
                if hit is not None:
                    if j == i + 1:
                        alone = False
                    total = here + hit[0]
                    if total > score[j]:
                        score[j], back[j], piece[j] = total, i, hit[1]
            if alone and here + self.v.unknown_score > score[i + 1]:
                score[i + 1], back[i + 1], piece[i + 1] = here + self.v.unknown_score, i, -1
        self.seen = max(self.seen, to)

    def _path(self, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > 0:
            start = self.back[end]
            out.append([self.piece[end]] if self.piece[end] >= 0 else self.v.bytes_of(self.text[start:end]))
            end = start
        return [i for ids in reversed(out) for i in ids]

    def _commit(self) -> list[int]:
        """Ids up to the boundary where all living paths meet: those that end at a position from
        which pieces are still to be scored (``seen`` and the positions scored beyond it)."""
        ends = {self.seen} | {j for j in range(self.seen + 1, min(self.seen + self.v.longest, len(self.text)) + 1) if self.back[j] >= 0}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(self.back[last])
        meet = ends.pop()
        if meet <= 0:
            return []
        ids = self._path(meet)
        self.text = self.text[meet:]
        base = self.score[meet]
        self.score = [s - base for s in self.score[meet:]]
        self.back = [-1] + [b - meet if b >= 0 else -1 for b in self.back[meet + 1:]]
        self.piece = [-1] + self.piece[meet + 1:]
        self.seen -= meet
        return ids


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.stream = StreamingViterbi(vocabulary)
        self.memo: dict[str, bytes] = {}                  # segment → committed ids as little-endian 32-bit numbers
        joined = "".join(map(re.escape, sorted(vocabulary.joined)))
        self.segments = re.compile(f"{MARK}*[{joined}]+|{MARK}+|.", re.S)
        self.word_start = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")

    def _committed(self, segment: str) -> bytes:
        """Ids that the stream commits for a segment (every path has a boundary on both its sides)."""
        packed = self.memo.get(segment)
        if packed is None:
            ids: list[int] = []
            for k in range(0, len(segment), FED):
                ids += self.stream.feed(segment[k: k + FED])
            packed = np.array(ids + self.stream.finish(), "<u4").tobytes()
            if len(segment) <= KEPT:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[segment] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        out, a, lead = bytearray(), 0, MARK
        while a < len(text):
            cut = self.word_start.search(text, a + PART) if self.v.marks_lead else None
            b = cut.start() if cut else len(text)
            if not self.v.marks_lead or b - a > 2 * PART:         # no boundary is known ahead: the stream alone finds them
                for k in range(a, b, FED):
                    out += np.array(self.stream.feed(lead + text[k: min(k + FED, b)].replace(" ", MARK)), "<u4").tobytes()
                    lead = ""
                out += np.array(self.stream.finish(), "<u4").tobytes()
            else:
                segments = self.segments.findall(lead + text[a:b].replace(" ", MARK))
                known = list(map(self.memo.get, segments))
                if None in known:
                    known = [self._committed(x) if ids is None else ids for x, ids in zip(segments, known)]
                out += b"".join(known)
            a, lead = b, ""
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a whole id list; equals the parts of :meth:`decode_parts` joined."""
        ids = list(ids)
        raw = b"".join(map(self.v.decoded.__getitem__, ids))
        first = next((i for i in ids if not self.v.special[i]), None)
        if first is not None and self.v.pieces[first].startswith(MARK):
            raw = raw[1:]
        return raw.decode(errors="replace")

    def decode_parts(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in parts, as ids arrive."""
        v, held, first = self.v, bytearray(), True
        for i in ids:
            b = v.byte_of[i]
            if b >= 0:
                held.append(b)
                first = False
                continue
            if held:
                yield held.decode(errors="replace")
                held.clear()
            if v.special[i]:
                continue
            p = v.pieces[i]
            if first:
                p, first = p.removeprefix(MARK), False
            yield p.replace(MARK, " ") if MARK in p else p
        if held:
            yield held.decode(errors="replace")


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec per worker process: its memo serves all tasks that the worker runs."""
    return Codec(Vocabulary(path))


def _round_trip(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            n, crc, sha, same, all_ids = [], [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                raw = codec.encode_packed(text)
                packed = np.frombuffer(raw, "<u4")
                back = codec.decode(packed.tolist())
                n.append(len(packed))
                crc.append(zlib.crc32(raw))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text.replace(MARK, " "))
                if with_ids:
                    all_ids.append(packed.astype(np.int32))
            out = [batch.column("id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]
            if with_ids:
                out.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: id, ``n_ids``, ``ids_crc32`` (little-endian 32-bit ids), ``decoded_sha256`` (of the
    decoded ids), ``round_trip`` (decoding gives the text back) and, if asked for, ``ids``."""
    schema = "id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else "")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_round_trip(model or model_path(), with_ids), schema).withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: id and the ``text`` of the ids (null ids: null text)."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return d.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
