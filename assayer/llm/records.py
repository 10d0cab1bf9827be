"""Token ids as length-delimited binary records with masked checksums and an offset index.

A data file is a row of records, a record is

    length   8 bytes   of the payload, little-endian
    check    4 bytes   masked CRC-32 of the length
    payload            flags (1 byte: bit 0 no id, bits 1-3 bytes a token), doc_id (8 bytes), token ids
    check    4 bytes   masked CRC-32 of the payload

A checksum is masked, that is rotated and moved by a constant, because records may hold checksums.
The index beside it has for each record its offset and its number of tokens (8 bytes each), so records
can be read in any order. Ids take two bytes if the vocabulary allows it.

Files are written by the tasks themselves, over pyarrow's file systems, under names that carry the
task attempt. The manifest, a stored table with one row per file, names the files of the attempts that
count; what a lost or repeated attempt left is never read. Documents are dealt out by ranges of
doc_id and of a hash of the text, and sorted, so files in order hold ascending ids and rows that share
an id lie in as many files as others. The number of files follows from the bytes of all texts. Texts
that come more than once near each other are encoded once.

Defined cases: a null text is empty and gives the end id alone; a null doc_id comes first and is
written as missing; rows that share an id stand together, equal texts side by side; an empty table gives an
empty manifest. Very long texts are one record. Other input columns are not read.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import store
from assayer.session import shared_dir

MASK_DELTA = 0xA282EAD8
FILE_BYTES = 16 << 20  # text in a file, until there would be more than MAX_FILES of them
MAX_FILES = 100_000
CACHE = 600_000  # encoded pieces in a generation of a worker's memory
_PIECE = 12  # characters of a remembered piece, on average; longer ones end a generation before
_BATCH = 256
_LINE = 1000  # pieces the library sees in one text
_WORDS = 100  # words the merges see in one text
_HEAD = re.compile(r"[^\W\d_]+")
_LINES = re.compile(r"[^\s\x1c-\x1f]+(?:\n[^\s\x1c-\x1f]+)+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTES = "".join(chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256))  # a byte-level vocabulary's character of each byte
_PROBES = ("a", "B7", "\u00e9", "\u4e2d", "'s", "x'", *"0!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

MANIFEST = "file_no int, data string, records long, tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """Payload at the stream's place, checked; None at the end."""
    head = stream.read(12)
    if not head:
        return None
    length, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    payload, tail = stream.read(length), stream.read(4)
    if len(payload) != length or struct.unpack("<I", tail)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


class Encoder:
    """Whole texts to token ids as bytes.

    A byte-level tokenizer cuts a text before a single space between two characters that are not
    white space, so the pieces between such spaces are encoded by the library once and remembered.
    Where its own pattern cuts pieces further, so do we: at single line feeds, and behind a run of letters
    that begins a piece. Such a run is one word to the pattern, so the library's merges see it without
    the pattern's work, a hundred at once with a byte between them that no merge holds. What is a letter
    says the library. Other new pieces go to the library as the lines of a text, and the ids are cut at the
    line feed's, where probes show that the vocabulary keeps lines apart. Texts with any other use of
    spaces go to the library whole.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.feed = self.library(["\n"])[0]
        self.apart = {lead for lead in ("", " ") if self._keeps_lines_apart(lead)}
        self.letters: dict[str, bool] = {}
        self.merges, self.gap = self._merges(path)
        self.memory: dict[str, tuple[dict, dict]] = {"first": ({}, {}), "rest": ({}, {})}
        self.chars = {"first": 0, "rest": 0}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own encoder for a vocabulary."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _merges(self, path: str):
        """The library's tokenizer without its pattern, and a byte that no merge holds; None where a run of letters may be more than its merges."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model, cut = own["model"], own.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(own.get(k) for k in ("normalizer", "truncation", "padding")) and model["vocab"].keys() >= set(BYTES)
        )
        for token in own.get("added_tokens", ()):  # found in the text before the pattern cuts it
            content = token["content"]
            plain = plain and not (token["lstrip"] or token["rstrip"] or _HEAD.match(content) or any(map(str.isspace, content)))
        if not plain or self.apart != {"", " "}:
            return None, None
        held = set(chain.from_iterable(chain.from_iterable(model["merges"])))
        gap = next((chr(b) for b in range(32) if BYTES[b] not in held and chr(b) != "\n"), None)
        bare = own | {"pre_tokenizer": None, "added_tokens": []}
        return (Tokenizer.from_str(json.dumps(bare)), gap) if gap else (None, None)

    def library(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind == "<u2" else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keeps_lines_apart(self, lead: str) -> bool:
        probes = [lead + p for p in _PROBES]
        return len(self.feed) == int(self.kind[2]) and self.library(["\n".join(probes)])[0] == self.feed.join(self.library(probes))

    def lines(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces that neither start nor end with white space, each behind ``lead``."""
        if lead not in self.apart:
            return self.library([lead + p for p in pieces])
        out: dict[str, bytes] = {}
        single = [p for p in pieces if "\n" not in p]
        parts = [single[at : at + _LINE] for at in range(0, len(single), _LINE)]
        feed = np.frombuffer(self.feed, self.kind)[0]
        for part, ids in zip(parts, self.library([lead + ("\n" + lead).join(part) for part in parts])):
            ends = (np.flatnonzero(np.frombuffer(ids, self.kind) == feed) * len(self.feed)).tolist()
            if len(ends) == len(part) - 1:  # else a piece holds a line feed's id of its own
                out.update(zip(part, (ids[a:b] for a, b in zip([0, *(e + len(self.feed) for e in ends)], [*ends, len(ids)]))))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self.library([lead + p for p in rest])))
        return [out[p] for p in pieces]

    def letter(self, c: str) -> bool:
        """Whether the vocabulary's pattern takes a character for a letter."""
        if c not in self.letters:
            self.letters[c] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + c)) == 1
        return self.letters[c]

    def words(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of runs of letters, each behind ``lead``, by the merges alone."""
        parts = [words[at : at + _WORDS] for at in range(0, len(words), _WORDS)]
        seen = [codecs.charmap_decode("".join([lead + w + self.gap for w in part]).encode(), "strict", BYTES)[0] for part in parts]
        gap, code = self.merges.token_to_id(BYTES[ord(self.gap)]), "H" if self.kind == "<u2" else "I"
        ids = b"".join([array(code, e.ids).tobytes() for e in self.merges.encode_batch_fast(seen, add_special_tokens=False)])
        ends = (np.flatnonzero(np.frombuffer(ids, self.kind) == gap) * len(self.feed)).tolist()
        return dict(zip(words, [ids[a:b] for a, b in zip([0, *[e + len(self.feed) for e in ends]], ends)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; equal ones are encoded once."""
        different = list(dict.fromkeys(texts))
        if len(different) == len(texts):
            return self._encode(texts)
        known = dict(zip(different, self._encode(different)))
        return [known[t] for t in texts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        first = self._known("first", [p[0] for p in cut], "")
        rest = self._known("rest", list(chain.from_iterable(p[1:] for p in cut)), " ")
        out, whole, at = [], [], 0
        for k, parts in enumerate(cut):
            ids = rest[at : at + len(parts) - 1]
            at += len(parts) - 1
            try:
                out.append(b"".join([first[k], *ids]))
            except TypeError:  # a piece the library has to see in its text
                whole.append(k)
                out.append(b"")
        for k, ids in zip(whole, self.library([texts[k] for k in whole])):
            out[k] = ids
        return out

    def _known(self, name: str, pieces: list[str], lead: str) -> list[bytes | None]:
        """Ids of each piece, None where it borders on white space; two generations are remembered."""
        young, old = self.memory[name]
        found = list(map(young.get, pieces))
        open_ = [k for k, ids in enumerate(found) if ids is None]
        new = {pieces[k] for k in open_}.difference(young)
        again = [p for p in new if p in old] if old else []
        young.update(zip(again, map(old.get, again)))
        if len(again) < len(new):
            self._learn(name, new.difference(again), lead, young)
        for k in open_:
            found[k] = young[pieces[k]]
        self.chars[name] += sum(map(len, new))
        if len(young) > CACHE or self.chars[name] > CACHE * _PIECE:
            self.memory[name], self.chars[name] = ({}, young), 0
        return found

    def _learn(self, name: str, new: set[str], lead: str, known: dict) -> None:
        """Adds the ids of new pieces to ``known``, None for those that border on white space."""
        words = set(filter(str.isalpha, new)) if self.merges else set()
        rest = new.difference(words)
        plain = [p for p in rest if p and not p[0].isspace() and not p[-1].isspace()]
        known.update(dict.fromkeys(rest.difference(plain)))
        if not self.merges:
            known.update(zip(plain, self.lines(plain, lead)))
            return
        lines, marked, whole = [], [], []
        for p in plain:
            if "\n" in p and _LINES.fullmatch(p):
                lines.append((p, *p.split("\n")))
            elif (m := _HEAD.match(p)) and (head := m[0]).isalpha() and not (c := p[len(head)]).isspace() and not self.letter(c):
                marked.append((p, head, p[len(head) :]))
            else:
                whole.append(p)
        # a word is one only where the library itself takes all its characters for letters
        words.update(head for _, head, _ in marked if head not in known)
        other = {c for c in set("".join(words)) if not self.letter(c)}
        if other:
            whole += [p for p in words if p in new and not other.isdisjoint(p)] + [p for p, head, _ in marked if not other.isdisjoint(head)]
            words = {p for p in words if other.isdisjoint(p)}
            marked = [x for x in marked if other.isdisjoint(x[1])]
        known.update(self.words(list(words), lead))
        known.update(zip(whole, self.lines(whole, lead)))
        for (p, head, _), ids in zip(marked, self._known("first", [tail for *_, tail in marked], "")):
            known[p] = known[head] + ids
        starts = self._known(name, [x[1] for x in lines], lead)
        more = iter(self._known("first", list(chain.from_iterable(x[2:] for x in lines)), ""))
        for x, ids in zip(lines, starts):
            known[x[0]] = self.feed.join([ids, *islice(more, len(x) - 2)])


def write(docs: DataFrame, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the token ids of all documents and returns the stored manifest."""
    from pyarrow import fs

    folder = folder or shared_dir(docs.sparkSession, "records")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = rows.repartitionByRange(max(1, -(-total // max(FILE_BYTES, total // MAX_FILES))), *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        encoder, context = Encoder.of(vocabulary), TaskContext.get()
        number = context.partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        width, name, data, index, offset, records, tokens = len(end), None, None, None, 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                if data is None:
                    name = f"{base}/part-{number:06d}-{context.taskAttemptId()}"
                    data, index = system.open_output_stream(name + ".rec", buffer_size=1 << 20), system.open_output_stream(name + ".idx", buffer_size=1 << 20)
                for key, ids in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"].to_pylist())):
                    ids += end
                    record = frame(struct.pack("<Bq", (key is None) | width << 1, key or 0) + ids)
                    data.write(record)
                    index.write(struct.pack("<QQ", offset, len(ids) // width))
                    offset, records, tokens = offset + len(record), records + 1, tokens + len(ids) // width
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict(
                {"file_no": pa.array([number], pa.int32()), "data": [name], "records": [records], "tokens": [tokens]}
            )

    manifest = store(ordered.mapInArrow(run, MANIFEST), "manifest")
    return manifest.withColumn("data", F.concat(F.lit(folder + "/"), F.substring_index("data", "/", -1)))


def read(manifest: DataFrame, with_ids: bool = False, order_seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files, every checksum verified.

    ``start`` is the number of tokens before the record over all files. With ``order_seed`` a file's
    records are visited in a seeded random order through the index.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file_no", "data", before.alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            for number, data, first in zip(part["file_no"], part["data"], part["first"]):
                yield from _read_file(data, int(first), with_ids, None if order_seed is None else [order_seed, int(number)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # a file a task; a given number is not merged at run time, however few rows the manifest has
    return files.repartitionByRange(max(1, manifest.count()), "file_no").mapInPandas(run, schema)


def _read_file(data: str, first: int, with_ids: bool, seed: list[int] | None) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(data)
    with system.open_input_stream(name + ".idx") as stream:
        index = np.frombuffer(stream.read(), "<u8").reshape(-1, 2).astype(np.int64)
    starts = first + np.cumsum(index[:, 1]) - index[:, 1]
    order = np.arange(len(index)) if seed is None else np.random.default_rng(seed).permutation(len(index))
    with system.open_input_file(name + ".rec") if seed is not None else system.open_input_stream(name + ".rec", buffer_size=1 << 20) as stream:
        for at in range(0, len(order), 1000):
            rows = []
            for k in order[at : at + 1000].tolist():
                if seed is not None:
                    stream.seek(int(index[k, 0]))
                payload = read_frame(stream)
                flags, key = struct.unpack_from("<Bq", payload)
                ids = np.frombuffer(payload, "<u2" if flags >> 1 == 2 else "<u4", offset=9).astype("<u4")
                if len(ids) != index[k, 1]:
                    raise ValueError("the index does not fit the record")
                rows.append((None if flags & 1 else key, int(starts[k]), len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] * with_ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
            yield out.astype({"doc_id": "Int64"})
