"""Token ids in flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import KEPT, batches, release, texts
from .scratch import Scratch

#: Words that a worker keeps with their ids before it starts anew, and the bytes above which a word is not kept.
CACHE, LONG = 1_000_000, 48
#: Words encoded at once: an encoding takes far more memory than its ids.
SOME = 256
#: A private-use character.
_BETWEEN = "\ue000".encode()
#: Stands for ids that aren't known: never the bytes of any ids, which are even in number.
_NONE = b"?"
#: A word of ASCII and Latin-1 letters, in UTF-8: no normalizer makes anything but letters of it.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: Such a word with ASCII signs after it, none of them an apostrophe.
_PARTED = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)").fullmatch
#: Bytes of the table, by the optimizer's estimate, that a shard holds at most.
SHARD_BYTES = 64 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith("file:") else uri if uri.startswith("/") else None


#: Normalizers that treat the words of a text alike wherever white space parts them.
_PLAIN_NORMALIZERS = frozenset("NFC NFD NFKC NFKD Lowercase StripAccents BertNormalizer".split())
_PLAIN_SPLITTERS = frozenset("Whitespace WhitespaceSplit BertPreTokenizer".split())
_PROBES = ("a b", " a", "a ", "1 2", "! ?", "' s", "a\t\tb", "\n", "x\r\ny", "it 's", "\u00e9 \u00e9", "  .  ", "a \u0301b")


def _pieces(step: dict | None) -> list[dict]:
    return [] if step is None else [y for x in step.get("normalizers") or step.get("pretokenizers") or [] for y in _pieces(x)] if step["type"] == "Sequence" else [step]


def check_tokenizer(path: str) -> None:
    """Raise unless a text's ids are those of its words in turn, whatever white space parts them.

    Accepted are tokenizers whose normalizers look at single characters and their marks
    (or make white space one space), whose first splitting step drops all white space, and
    whose added tokens neither hold white space nor take it in.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normalizers, splitters = _pieces(made.get("normalizer")), _pieces(made.get("pre_tokenizer"))
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    good = all(n["type"] in _PLAIN_NORMALIZERS or n == spaces for n in normalizers) and bool(splitters)
    if good and splitters[0]["type"] == "Split":
        pattern = splitters[0]["pattern"].get("Regex")
        good = splitters[0]["behavior"] == "Removed" and splitters[0]["invert"] and pattern is not None
        good = good and not any(c.isspace() for x in _PROBES for found in regex.finditer(pattern, x) for c in found[0])
    else:
        good = good and splitters[0]["type"] in _PLAIN_SPLITTERS
    good = good and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", []))
    if good:
        tokenizer = Tokenizer.from_file(path)
        ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
        good = all(ids(x) == [i for w in x.split() for i in ids(w)] for x in _PROBES)
    if not good:
        raise ValueError(f"{path}: this tokenizer may join words across white space, so texts can't be encoded word by word")


class Encoder:
    """Ids of whole texts, one word at a time, for tokenizers that pass :func:`check_tokenizer`.

    Words are split at ASCII white space; each word new to the cache is encoded once a
    batch, many to a call, as a call's overhead is more than a word's encoding. Words of
    plain letters are joined by spaces where the model marks the ends of words in its
    vocabulary: the marks tell the words' ids apart. Where the tokenizer parts runs of
    letters from runs of other signs, letters with signs after them are put together from
    both. Other words are joined by a word that none of them holds, whose ids then stand
    between theirs.
    """

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[dtype]
        self.known: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
        self.between = self._encode([_BETWEEN])[0]
        with open(path, encoding="utf-8") as f:
            first = _pieces(json.load(f).get("pre_tokenizer"))[:1]
        rules = set((first[0].get("pattern", {}).get("Regex") or "").split("|")) if first and first[0]["type"] == "Split" else set()
        self.parts = {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= rules and all(r == r"[\p{N}]" or r[0] == "'" for r in rules - {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"})

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _cut(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray, words: list[bytes]) -> list[bytes]:
        if len(start) != len(words):
            return [x.tobytes() for x in self._encode(words)]
        raw, n = ids.tobytes(), ids.itemsize
        return [raw[a:b] for a, b in zip((start * n).tolist(), (end * n).tolist(), strict=True)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one piece each, or more if the tokenizer splits letters, which the count shows."""
        ids = self._encode([b" ".join(words)])[0]
        end = np.flatnonzero(self.ends[ids]) + 1
        return self._cut(ids, np.concatenate(([0], end[:-1])), end, words)

    def _others(self, words: list[bytes]) -> list[bytes]:
        n = len(self.between)
        if not n or any(_BETWEEN in w for w in words):
            return [x.tobytes() for x in self._encode(words)]
        ids = self._encode([(b" " + _BETWEEN + b" ").join(words)])[0]
        here = np.ones(max(0, len(ids) - n + 1), bool)
        for k in range(n):
            here &= ids[k : k + len(here)] == self.between[k]
        at = np.flatnonzero(here)
        return self._cut(ids, np.concatenate(([0], at + n)), np.concatenate((at, [len(ids)])), words)

    def _learn(self, fresh: dict[bytes, None]) -> None:
        """Encode words, and those that they are put together from."""
        letters, others, parted = [], [], []
        for w in fresh:
            if self.ends is not None and (w.isalpha() or _LETTERS(w)):
                letters.append(w)
            elif self.parts and (m := _PARTED(w)):
                parted.append((w, m[1], m[2]))
            else:
                others.append(w)
        pieces = {x: None for _, a, b in parted for x in (a, b) if x not in self.known and x not in fresh}
        for x in pieces:
            (letters if self.ends is not None and (x.isalpha() or _LETTERS(x)) else others).append(x)
        for some, encode in ((letters, self._letters), (others, self._others)):
            for lo in range(0, len(some), SOME):
                self.known.update(zip(some[lo : lo + SOME], encode(some[lo : lo + SOME]), strict=True))
        for w, a, b in parted:
            self.known[w] = self.known[a] + self.known[b]
        fresh |= pieces

    def __call__(self, values: list[bytes]) -> list[bytes]:
        """Ids of each text; no cycles arise, so the collector, which would walk all words again and again, rests meanwhile."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._texts(values)
        finally:
            if on:
                gc.enable()

    def _texts(self, values: list[bytes]) -> list[bytes]:
        split = [v.split() for v in values]
        if len(self.known) > CACHE:
            self.known = {w: ids for w in set().union(*split) if (ids := self.known.get(w)) is not None}
        found = [list(map(self.known.get, s, repeat(_NONE))) for s in split]
        fresh, holes = {}, []
        for s, f in zip(split, found, strict=True):
            if n := f.count(_NONE):
                k = -1
                for _ in range(n):
                    k = f.index(_NONE, k + 1)
                    fresh[s[k]] = None
                    holes.append((f, k, s[k]))
        self._learn(fresh)
        for f, k, w in holes:
            f[k] = self.known[w]
        for w in fresh:
            if len(w) > LONG:
                del self.known[w]
        return [b"".join(f) for f in found]


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> Encoder:
    """One for all tasks that a worker runs, so that its words stay known."""
    return Encoder(path, dtype)


KEPT.append(encoder.cache_clear)


def _writer(folder: str, path: str, end: int, dtype: str) -> Callable:
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width, tail = encoder(path, dtype), np.dtype(dtype).itemsize, np.array([end], dtype).tobytes()
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"  # a task that runs again writes files of its own
        fs, root = _fs(folder)
        n = docs = 0
        with fs.open_output_stream(f"{root}/{name}.ids") as ids, fs.open_output_stream(f"{root}/{name}.off") as off, fs.open_output_stream(f"{root}/{name}.doc") as doc:
            for b in batches(it, 1024):
                data = [x + tail for x in encode(texts(b["text"]))]
                ends = n + np.cumsum([len(x) // width for x in data], dtype=np.int64)
                off.write(np.concatenate(([n], ends[:-1])).astype("<i8").tobytes())
                doc.write(np.array([(0, 0) if d is None else (d, 1) for d in b["doc_id"].to_pylist()], "<i8").tobytes())
                for x in data:
                    ids.write(x)
                n, docs = int(ends[-1]), docs + len(data)
        release(keep=True)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "docs": pa.array([docs], pa.int64()), "ids": pa.array([n], pa.int64())})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2) -> str:
    """Encode all texts into files in folder, in ascending doc_id order; returns the manifest's path.

    Documents are dealt to shards by ranges of doc_id and sorted inside each. A shard
    has ``.ids`` (all ids, 16 bits if the vocabulary allows, else 32, little-endian),
    ``.off`` (64-bit start of each document within the shard) and ``.doc`` (doc_id and
    whether it is set, 64 bits each). ``manifest.json`` names the files that count and
    gives each shard's base: the prefix sum of the shards before it. A task that is run
    again writes under another name, so nothing half-written is ever read. The driver
    sees one row a shard.

    Shards are as many as keep them to SHARD_BYTES by the optimizer's estimate, and no
    fewer than the session's shuffle partitions. A tokenizer that may join words across
    white space is refused.

    Null text is empty and yields the end id alone; a null doc_id comes first; equal
    doc_ids stand side by side in any order. An empty table gives a manifest without
    documents. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    check_tokenizer(tokenizer)
    dtype = "<u2" if max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size() - 1) < 1 << 16 else "<u4"
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES if size < 1 << 60 else 0)
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id")
    shards = sorted(rows.mapInArrow(_writer(folder, tokenizer, end_id, dtype), "shard int, name string, docs long, ids long").collect())
    base, listed = 0, []
    for s in shards:
        listed.append({"name": s.name, "base": base, "docs": s.docs, "ids": s.ids})
        base += s.ids
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "ids": base, "shards": listed}).encode())
    return f"{folder}/manifest.json"


class Shard:
    """A shard's documents: memory-mapped where the folder is a local or mounted one, else read a range at a time."""

    def __init__(self, folder: str, name: str, dtype: str) -> None:
        self.uri, self.dtype = f"{folder}/{name}", np.dtype(dtype)
        path = _local(self.uri)
        if path is None:
            fs, self.inside = _fs(self.uri)
            self.open, self.mapped = fs.open_input_file, None
            self.size = fs.get_file_info(f"{self.inside}.ids").size // self.dtype.itemsize
        else:
            self.mapped = {x: np.memmap(f"{path}.{x}", t, "r") if os.path.getsize(f"{path}.{x}") else np.empty(0, t) for x, t in (("ids", dtype), ("off", "<i8"), ("doc", "<i8"))}
            self.size = len(self.mapped["ids"])

    def _range(self, kind: str, dtype: np.dtype | str, lo: int, hi: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[kind][lo:hi]
        width = np.dtype(dtype).itemsize
        with self.open(f"{self.inside}.{kind}") as f:
            f.seek(lo * width)
            return np.frombuffer(f.read((hi - lo) * width), dtype)

    def documents(self, lo: int, hi: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start and ids of the documents in places lo to hi of the shard."""
        starts = self._range("off", "<i8", lo, hi + 1).tolist()
        starts = starts if len(starts) > hi - lo else [*starts, self.size]
        ids = self._range("ids", self.dtype, starts[0], starts[-1])
        for (d, named), a, b in zip(self._range("doc", "<i8", 2 * lo, 2 * hi).reshape(-1, 2).tolist(), starts[:-1], starts[1:], strict=True):
            yield d if named else None, a, ids[a - starts[0] : b - starts[0]]


def _reader(folder: str, dtype: str, some: int = 512) -> Callable:
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, base, docs in zip(b["name"].to_pylist(), b["base"].to_pylist(), b["docs"].to_pylist(), strict=True):
                shard = Shard(folder, name, dtype)
                for lo in range(0, docs, some):
                    found = [(d, base + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, a, ids in shard.documents(lo, min(lo + some, docs))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_digest(spark: SparkSession, manifest: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    fs, inside = _fs(manifest)
    with fs.open_input_file(inside) as f:
        m = json.loads(f.read())
    folder = manifest.rpartition("/")[0]
    shards = [(s["name"], s["base"], s["docs"]) for s in m["shards"] if s["docs"]]
    rows = spark.createDataFrame(shards, "name string, base long, docs long").repartition(max(1, len(shards)))
    return rows.mapInArrow(_reader(folder, m["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """:func:`write_tokens` into the shared folder and :func:`read_digest` of it."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_digest(docs.sparkSession, write_tokens(docs, f"{scratch.path}/files", tokenizer, end_id=end_id))
