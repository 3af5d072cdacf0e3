"""SentencePiece BPE encoding by a prefix table, and decoding.

A BPE encoding is right exactly if every two neighbouring tokens are what BPE makes of their joined
text, and every prefix of a text has one encoding.  So a prefix is known by its last token: for each
position, the tokens that end there come from an Aho-Corasick automaton over the pieces, and the one
that is compatible with the last token of the prefix before it is stored.  The ids are recovered from the
end of the table backwards.  Whether a pair is compatible is found once by merging its joined text, and kept.

BPE never merges across a pair of neighbouring characters that no piece holds, so texts are cut before
runs of the space mark and at line ends, where the vocabulary allows it (``Vocabulary.pattern``),
and equal parts of a task are encoded once.  Memory is bounded by ``MEMO`` parts and ``MEMO`` pairs,
after which the tables start anew.  A part without a cut (a very long word) takes time linear in its length.

The vocabulary (a file of fixed size, about half a MB) travels to the tasks in their function;
executors need not see the file.

Defined cases: null text is empty; an empty text has no ids and decodes to an empty text; a null id or
repeated rows pass through row by row, in no order; an empty table gives an empty table; ties between
merges go to the higher score, then to the leftmost pair, as in the library; characters without a piece
become the pieces of their UTF-8 bytes; in decoding, a byte that is no part of a character becomes
U+FFFD, control pieces vanish and a null list of ids gives a null text.  Columns are taken by position
and name before anything is added, so extra columns with clashing names are never read or lost:
``encode`` returns only its own two columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

SPACE = "▁"
#: Parts of texts, and pairs of pieces, that a task remembers.
MEMO = 1 << 18
#: Below every score.
NEVER = float("-inf")
#: Rows that a task turns at a time.
ROWS = 1024


class Vocabulary(NamedTuple):
    """A BPE model with byte fallback as plain values: pieces by id, their scores, and what decoding prints."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    printed: list[str]
    spaced: frozenset[int]
    dummy_prefix: bool
    pattern: str


def load(path: str) -> Vocabulary:
    """The vocabulary in the model file at ``path``."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
    if (model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("BPE models with byte fallback, without normalisation, are supported")
    pieces, scores, byte_ids, printed, spaced = {}, {}, [0] * 256, [], set()
    for k, p in enumerate(model.pieces):
        shown = ""
        if p.type == kind.NORMAL:
            pieces[p.piece], scores[p.piece] = k, p.score
            shown = p.piece.replace(SPACE, " ")
            if p.piece.startswith(SPACE):
                spaced.add(k)
        elif p.type == kind.BYTE:
            b = int(p.piece[3:5], 16)
            byte_ids[b], shown = k, chr(b) if b < 128 else chr(0xDC00 + b)
        elif p.type == kind.UNKNOWN:
            shown = model.trainer_spec.unk_surface
        elif p.type != kind.CONTROL:
            raise ValueError(f"piece {k} is of a kind that is not supported")
        printed.append(shown)
    return Vocabulary(pieces, scores, byte_ids, printed, frozenset(spaced), rules.add_dummy_prefix, _pattern(pieces))


def _pattern(pieces: dict[str, int]) -> str:
    """Expression of the parts of a text that no merge leaves."""
    joined = [p for p in pieces if len(p) > 1]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joined):
        return r"(?s).+"
    alone = "".join(c for c in "\t\n\r" if not any(c in p for p in joined))
    return f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")


class Encoder:
    """Encodes texts with a vocabulary; built once in a task."""

    def __init__(self, vocab: Vocabulary) -> None:
        import ahocorasick

        self.vocab, self.find = vocab, re.compile(vocab.pattern).findall
        self.automaton = ahocorasick.Automaton()
        for p in vocab.pieces:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.known = 0

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text: the best-scored pair merges first, the leftmost of equal ones."""
        score, parts = self.vocab.scores.get, list(text)
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > NEVER:
            at = gains.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            for k in (at - 1, at):
                if 0 <= k < len(gains):
                    gains[k] = score(parts[k] + parts[k + 1], NEVER)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether BPE leaves ``left`` and ``right`` as they are when one follows the other; found once and kept."""
        self.known += 1
        found = self.pairs[left][right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def last_tokens(self, part: str) -> list[str]:
        """The last token of every prefix of ``part`` (an empty string for the empty prefix)."""
        if self.known >= MEMO:
            self.known = 0
            self.pairs.clear()
        last: list[str | None] = ["", *[None] * len(part)]
        pairs, compatible = self.pairs, self.compatible
        for at, token in self.automaton.iter(part):  # all tokens that end at one position, then those of the next
            at += 1
            if last[at] is None:
                before = at - len(token)
                left = last[before]
                if left is None:  # no token ends there: a character without a piece
                    left = last[before] = part[before - 1]
                fits = pairs[left].get(token)
                if compatible(left, token) if fits is None else fits:
                    last[at] = token
        if None in last:
            last = [last[0], *[part[k] if t is None else t for k, t in enumerate(last[1:])]]
        return last

    def ids(self, last: list[str]) -> tuple[int, ...]:
        """The ids of a part, recovered backwards from the table of its last tokens."""
        at, ids, piece = len(last) - 1, [], self.vocab.pieces.get
        while at:
            token = last[at]
            k = piece(token)
            if k is not None:
                ids.append(k)
            else:
                ids += [self.vocab.byte_ids[b] for b in reversed(token.encode("utf-8", "replace"))]
            at -= len(token)
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self.parts) >= MEMO:
            self.parts.clear()
        known, ids = self.parts, []
        for part in self.find((SPACE if self.vocab.dummy_prefix else "") + text.replace(" ", SPACE)):
            found = known.get(part)
            if found is None:
                found = known[part] = self.ids(self.last_tokens(part))
            ids += found
        return ids


def spell(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of ``ids`` (bytes outside characters as U+FFFD, one for each)."""
    text = "".join(map(vocab.printed.__getitem__, ids))
    if vocab.dummy_prefix and next((k for k in ids if vocab.printed[k]), -1) in vocab.spaced:
        text = text[1:]
    if re.search("[\udc80-\udcff]", text):
        whole = text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")
        text = re.sub("[\udc80-\udcff]", "�", whole)
    return text


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                ids = [np.array(x, dtype=np.int32) for x in map(encoder.encode, b.column(1).to_pylist())]
                ends = np.array([0, *accumulate(map(len, ids))], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                text = [spell(vocab, ids.values.to_numpy(zero_copy_only=False).tolist()) if ids.is_valid else None for ids in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids (decimal, comma-joined) and of the decoded text."""
    spelt = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(spelt.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
