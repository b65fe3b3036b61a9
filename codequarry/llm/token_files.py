"""Token ids in binary shard files of patched frame-of-reference blocks.

File (all integers little-endian)::

    magic     b"PFORTOK1"
    ids       blocks of BLOCK ids, see ``pack``
    documents two more runs of blocks over unsigned 64-bit values: zigzag differences of document ids, and token counts
    index     u64 start of every block of each run, in order
    footer    u64: documents, documents without an id (they lead), ids, blocks of ids, of document ids and of counts, start of
              the index; then the magic

A block holds the least value, a width that all but the largest values fit (a percentile), the differences packed at that
width, and the outliers with their places. The index lets a reader take any document's ids without reading the others.
Shards hold ascending document ids, in the order of their numbers; a shard is closed when it has ``shard_ids`` ids.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import memo, new_path, prepared

MAGIC, BLOCK, PERCENTILE = b"PFORTOK1", 4096, 98.0
_FOOTER = "<7Q8s"
_HEAD = "<QHBxI"  # least value, values, width, outliers
MOST_WORDS, LONGEST_WORD, GROUP = 300_000, 40, 1 << 20


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most BLOCK unsigned 64-bit values."""
    least = values.min()
    rest = values - least
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    far = np.flatnonzero(rest >> np.uint64(width)) if width < 64 else np.zeros(0, np.int64)
    low = rest.copy()
    low[far] = 0
    bits = np.unpackbits(low.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
    return (struct.pack(_HEAD, int(least), len(values), width, len(far)) + np.packbits(bits, bitorder="little").tobytes()
            + far.astype("<u2").tobytes() + rest[far].astype("<u8").tobytes())


def unpack(data: bytes, start: int) -> np.ndarray:
    least, n, width, far = struct.unpack_from(_HEAD, data, start)
    at = start + struct.calcsize(_HEAD)
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, :width] = bits
    rest = np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
    at += size
    places = np.frombuffer(data, "<u2", far, at)
    rest[places] = np.frombuffer(data, "<u8", far, at + 2 * far)
    return rest + np.uint64(least)


def shard_bytes(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    zigzag = np.diff(np.array([d or 0 for d in doc_ids], np.int64), prepend=0)
    zigzag = ((zigzag << 1) ^ (zigzag >> 63)).view(np.uint64)
    out, starts, sizes, at = [MAGIC], [], [], len(MAGIC)
    for values in (ids, zigzag, np.array(counts, np.uint64)):
        blocks = [pack(values[i:i + BLOCK].astype(np.uint64)) for i in range(0, len(values), BLOCK)]
        for block in blocks:
            starts.append(at)
            at += len(block)
        out += blocks
        sizes.append(len(blocks))
    out.append(np.array(starts, "<u8").tobytes())
    out.append(struct.pack(_FOOTER, len(doc_ids), doc_ids.count(None), len(ids), *sizes, at, MAGIC))
    return b"".join(out)


class Shard:
    """A shard's contents; ``ids(a, b)`` unpacks only the blocks it needs."""

    def __init__(self, data: bytes):
        self.data = data
        self.documents, self.nulls, self.size, n_ids, n_docs, n_counts, index, magic = struct.unpack_from(_FOOTER, data, len(data) - struct.calcsize(_FOOTER))
        if magic != MAGIC or data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        starts = np.frombuffer(data, "<u8", n_ids + n_docs + n_counts, index)
        self.starts = starts[:n_ids]
        zigzag = self._run(starts[n_ids:n_ids + n_docs])
        self.doc_ids = np.cumsum((zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64))
        self.counts = self._run(starts[n_ids + n_docs:]).astype(np.int64)
        self._held = (-1, None)

    def _run(self, starts):
        return np.concatenate([unpack(self.data, int(s)) for s in starts]) if len(starts) else np.zeros(0, np.uint64)

    def _block(self, k):
        if self._held[0] != k:
            self._held = (k, unpack(self.data, int(self.starts[k])).astype("<u4"))
        return self._held[1]

    def ids(self, first: int, last: int) -> np.ndarray:
        if first == last:
            return np.zeros(0, "<u4")
        parts = [self._block(k)[max(0, first - k * BLOCK):last - k * BLOCK] for k in range(first // BLOCK, (last - 1) // BLOCK + 1)]
        return np.concatenate(parts)


# letters, then ASCII marks other than the apostrophe: two pre-tokens of a vocabulary that parts letters from marks
_PARTS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "'_")
# fixed values: the steps of vocabularies whose texts are their words, one after the other
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
          {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def by_words(definition: str) -> bool:
    """Whether a tokenizer's definition is known to encode a text word by word: it composes, lower-cases and splits in the way given above, and
    the strings of its added tokens hold ``<|`` and no white space."""
    d = json.loads(definition)
    added = [t["content"] for t in d.get("added_tokens") or []]
    return ((d.get("normalizer") or {}).get("normalizers") == _NORMAL and (d.get("pre_tokenizer") or {}).get("pretokenizers") == _SPLIT
            and d.get("post_processor") is None and not d.get("truncation") and not d.get("padding")
            and d["model"].get("type") == "BPE" and not d["model"].get("dropout")
            and all("<|" in t and not re.search(r"\s", t) for t in added))


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: its own where Latin-1 has a visible one, else those from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Ids of words by the tokenizers library; known words are looked up. The steps of ``by_words`` vocabularies never join characters across
    white space, so a text is its words; and a word of plain letters that ends in ASCII marks is its letters and its marks. Plain are
    letters below U+0530 that stay letters when they are composed and lower-cased: not so U+0130, which ends in a mark. Plain letters
    and marks alone are one pre-token, which the library's model takes as it is; anything else goes through all its steps. Texts of any
    other vocabulary are encoded whole. The table is bounded: a full one becomes the elder, from which words that are met again return, so
    that frequent words stay and rare ones go."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.by_words = by_words(definition)
        self.signs = _byte_signs()
        self.elder: dict[str, bytes] = {}

    def _through(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, word: str, packed: bytes) -> bytes:
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.elder = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def _model(self, pretoken: str) -> bytes:
        signs = pretoken if pretoken.isascii() else "".join([self.signs[b] for b in pretoken.encode()])
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _single(self, pretoken: str) -> bytes:
        """Ids of a piece that is known to be one pre-token in its normal form."""
        packed = self.get(pretoken)
        if packed is None:
            packed = self.elder.get(pretoken)
            return self._keep(pretoken, self._model(pretoken) if packed is None else packed)
        return packed

    @staticmethod
    def _plain(letters: str) -> str | None:
        """The normal form of plain letters."""
        if letters.isascii():
            return letters.lower() if letters.isalpha() else None
        if max(letters) >= "\u0530" or "\u03a3" in letters:  # capital sigma: its small form depends on who asks
            return None
        normal = unicodedata.normalize("NFC", letters).lower()
        return normal if normal.isalpha() and max(normal) < "\u0530" else None

    def _new(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isascii() and core.isalpha():
            normal, marks = core.lower(), word[len(core):]
        elif normal := self._plain(word) if word else None:
            marks = ""
        elif parts := _PARTS.fullmatch(word):
            normal, marks = self._plain(parts[1]), parts[2]
        if not normal or "<|" in marks:
            return self._through(word) if word else b""
        if marks:
            return self._single(normal) + self._single(marks)
        return self._model(word) if normal == word else self._single(normal)

    def __missing__(self, word: str) -> bytes:
        packed = self.elder.get(word)
        return self._keep(word, self._new(word) if packed is None else packed)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; a long one is cut at spaces."""
        if not self.by_words:
            return self._through(text)
        text, out, at = text.replace("\n", " "), [], 0
        while at < len(text):
            end = len(text)
            if end - at > GROUP and (cut := text.find(" ", at + GROUP)) >= 0:
                end = cut
            out += map(self.__getitem__, text[at:end].split(" "))
            at = end + 1
        return b"".join(out)


def _whole(definition: str) -> Words:
    held = memo("token words")
    if definition not in held:
        held.clear()
        held[definition] = Words(definition)
    return held[definition]


def _store(folder: str):
    """The file system of a shared folder: a plain path or any address that Arrow knows."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def _publish(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, f"{path}/{name}")


_MANIFEST = "shard bigint, part bigint, file string, n_docs bigint, n_ids bigint"


def write(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int = 1, text: str = "text", key: str = "doc_id",
          shard_ids: int = 4_000_000) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards in ascending ``key`` order; returns the stored manifest
    (shard, part, file, n_docs, n_ids).

    A null or empty text is its end id alone. Rows with the same key follow each other, ordered by text; null
    keys come first and stay null. Other columns are not looked at. An empty table gives no file and an empty manifest.
    """
    spark = prepared(docs.sparkSession)
    with open(tokenizer_json, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the data

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        words, part = _whole(definition.value), TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        doc_ids, packed, size, done = [], [], 0, 0

        def close():
            name = f"shard-{part:06d}-{done:06d}.pfor"
            counts, data = [len(p) // 4 for p in packed], np.frombuffer(b"".join(packed), "<u4")
            packed.clear()
            _publish(folder, name, shard_bytes(doc_ids, counts, data))
            return pa.RecordBatch.from_pydict({"shard": [part], "part": [done], "file": [name], "n_docs": [len(doc_ids)], "n_ids": [size]})

        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(content or "") + end
                doc_ids.append(doc_id)
                packed.append(ids)
                size += len(ids) // 4
                if size >= shard_ids:
                    yield close()
                    doc_ids, packed, size, done = [], [], 0, done + 1
        if doc_ids:
            yield close()

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = rows.repartitionByRange(tasks, "k").sortWithinPartitions("k", "t").mapInArrow(run, _MANIFEST)
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path)


def read(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of the shards that the manifest names: key, start (ids of all documents before it), ids (little-endian unsigned
    32-bit, binary)."""
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    begins = manifest.select("file", F.coalesce(before, F.lit(0)).alias("begin"))  # one row for each file

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_buffer().to_pybytes())
                ends = np.cumsum(shard.counts)
                for a in range(0, shard.documents, 500):
                    b = min(a + 500, shard.documents)
                    ids = [shard.ids(int(e - n), int(e)).tobytes() for e, n in zip(ends[a:b], shard.counts[a:b])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (b - a)), pa.array(shard.doc_ids[a:b], mask=np.arange(a, b) < shard.nulls), pa.array(ends[a:b] - shard.counts[a:b]), pa.array(ids, pa.binary())],
                        ["file", "k", "offset", "ids"])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.pfor").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    found = files.mapInArrow(run, "file string, k bigint, offset bigint, ids binary")
    return found.join(begins, "file").select(F.col("k").alias(key), (F.col("begin") + F.col("offset")).alias("start"), "ids")


def round_trip(docs: DataFrame, tokenizer_json: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer_json, end_id), folder)

