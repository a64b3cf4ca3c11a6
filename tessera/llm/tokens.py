"""Token ids of whole texts: a word encoder over Arrow columns, and the pieces that documents are cut into.

A slice of texts is cut at ASCII white space and its words are numbered by Arrow; only words that a worker does not remember
are encoded, many at a time, and the ids of the texts are gathered from those of their words in one step.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import built_once

CLOSING_ID = 1
#: Word encodings that a worker keeps in each half of its memory.
KEPT_WORDS = 150_000
#: Bytes of text that are encoded together; a longer text is encoded by itself.
SLICE_BYTES = 4_000_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def printable_bytes() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, the others from U+0100 on in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in kept)}


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens do not span ASCII white space, word by word with memory.

    New words are cut as the tokenizer's own rule cuts them, and its vocabulary alone, without rules, encodes the parts, many at a
    time; the ids are told apart by their end-of-word marks. Words outside the Latin blocks go through the whole tokenizer.
    """

    #: Characters below U+0180 that neither compose nor change their number in lower case.
    LATIN = re.compile("[!-~¡-įı-ſ]+").fullmatch
    #: The tokenizer's rule for cutting, after lower-casing.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    CUT = regex.compile(SPLIT).findall
    TOGETHER = 500

    def __init__(self, path: str, closing_id: int = CLOSING_ID, kept_words: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        cutting = [r.get("pattern", {}).get("Regex") for r in steps]
        if (
            rules["model"].get("end_of_word_suffix") != "</w>"
            or cutting[:1] != [self.SPLIT]
            or [r["type"] for r in steps[1:]] != ["ByteLevel"]
            or {"type": "Lowercase"} not in (rules["normalizer"] or {}).get("normalizers", [])
        ):
            raise ValueError(f"{path} does not cut words as this encoder does")
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.printable = printable_bytes() | {0x20: " "}
        self.closing_id = closing_id
        self.kept_words = kept_words
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # older entries are let go half at a time
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and where each part's ids end."""
        groups = [" ".join(parts[i : i + self.TOGETHER]).encode().decode("latin-1").translate(self.printable) for i in range(0, len(parts), self.TOGETHER)]
        ids = np.array([i for e in self.bare.encode_batch_fast(groups, add_special_tokens=False) for i in e.ids], dtype="<u4")
        return ids, np.flatnonzero(self.ends_word[ids]) + 1

    def _learn(self, words: list[str]) -> None:
        latin = words if self.LATIN("".join(words)) else [w for w in words if self.LATIN(w)]
        parts: list[str] = []
        ends = []
        for w in latin:
            if w.isalpha():
                parts.append(w.lower())
            elif w[-1] in ".," and w[:-1].isalpha():
                parts += (w[:-1].lower(), w[-1])
            else:
                parts += self.CUT(w.lower())
            ends.append(len(parts))
        ids, part_ends = self._parts_ids(parts)
        if len(part_ends) == len(parts):
            at = 4 * np.concatenate([[0], part_ends])[[0, *ends]]
            raw, at = ids.tobytes(), at.tolist()
            self.new.update((w, raw[a:b]) for w, a, b in zip(latin, at, at[1:], strict=False))
        else:
            self.new.update((w, self._ids(w)) for w in latin)
        if len(latin) < len(words):
            self.new.update((w, self._ids(w)) for w in words if not self.LATIN(w))

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of the words, which are distinct."""
        if len(self.new) > self.kept_words:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            aged = [(words[i], ids) for i in missing if (ids := self.old.get(words[i])) is not None]
            self.new.update(aged)
            if len(aged) < len(missing):
                self._learn([words[i] for i in missing if words[i] not in self.new])
            for i in missing:
                found[i] = self.new[words[i]]
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each text's closed by the closing id, and where each text's begin (and the last's end)."""
        # where a special token's string may stand, the tokenizer itself looks for it
        marked = pc.fill_null(pc.match_substring(texts, "<|"), False)
        special = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        whole = [self._ids(texts[i].as_py()) for i in special.tolist()]
        if whole:
            texts = pa.array([None if m else t for m, t in zip(marked.to_pylist(), texts.to_pylist(), strict=True)], texts.type)
        lines = pc.ascii_split_whitespace(texts)
        words = lines.flatten()
        numbered = words.dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
        numbers = numbered.indices.to_numpy(zero_copy_only=False)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        # white space at either end of a text leaves an empty word there
        known = self._known([w for w in distinct if w])
        if "" in distinct:
            known.insert(distinct.index(""), b"")
        pool = [*known, *whole, np.array([self.closing_id], dtype="<u4").tobytes()]
        ends = np.cumsum(counts)
        added = np.concatenate([ends[special], ends]), np.concatenate([len(known) + np.arange(len(special)), np.full(len(texts), len(pool) - 1)])
        by_text = np.argsort(np.concatenate([2 * special, 2 * np.arange(len(texts)) + 1]))
        numbers = np.insert(numbers, added[0][by_text], added[1][by_text])
        counts = counts + 1
        counts[special] += 1
        taken = pa.array(pool, pa.large_binary()).take(pa.array(numbers))
        to = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1) // 4
        return np.frombuffer(taken.buffers()[2], dtype="<u4", count=int(to[-1])), to[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and the closing id."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of the texts in ``column``, at least one row each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // size
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def token_pieces(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): the pieces of each document, ids as little-endian uint32 bytes.

    A document is cut at multiples of ``capacity`` alone. The checksum is that of the ids' bytes, unsigned. Without ``with_ids`` the ids
    stay in the workers that made them.
    """
    path = tokenizer_path or default_tokenizer_path()
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = built_once("encoder", path, lambda: WordEncoder(path))
        for batch in text_slices(batches, 1):
            ids, at = encoder.encode_column(batch.column(1))
            totals = np.diff(at)
            pieces = -(-totals // capacity)
            doc = np.repeat(np.arange(len(totals)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, totals[doc] - start)
            raw = memoryview(ids).cast("B")
            cuts = [raw[4 * a : 4 * b] for a, b in zip((at[doc] + start).tolist(), (at[doc] + start + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(totals[doc]), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
            if with_ids:
                columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
            del ids, raw, cuts
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
