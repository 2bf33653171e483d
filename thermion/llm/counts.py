"""Token counts by a tokenizer compiled to a finite-state transducer.

A byte-level BPE file becomes a deterministic transducer over characters. Its output after any prefix is
the number of tokens of that prefix alone, so a transition carries the tokens it adds, or takes back when
a character joins what was counted apart. A state holds

* where the text is between words: in letters, digits, marks, white space or behind an apostrophe;
* for the last few bytes, as far back as a token that is still open can begin: the last token of every
  prefix that ends there, and how many tokens it has. The last token of a longer prefix is the one token
  that ends there and stands next to the last token of what is before it (they stay two when both are
  encoded together), so these places settle all that follows;
* how much of a special token's string has been read.

States and transitions are made when a text first needs them and kept by each Python worker. Classes of
characters are asked of the library, so that both know the same Unicode.

Long texts are cut into chunks, which tasks read apart from each other. A chunk is a map from the state at
its beginning to the state and count at its end. All states are left alike where white space follows
something else, so the map is the text before the first such place, the tokens between the first and the
last, and the text behind the last, which names the state at the end. Maps compose associatively: a prefix
scan in rounds of FAN neighbours gives the tokens before each chunk, and the last state's of the text.

Defined results: null text is empty and has no tokens; null and repeated ids are rows like any other; an
empty table gives an empty result; other columns are ignored. A run without any white space is carried
from map to map as text, so a map is never longer than its row.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

DEFAULT, LIMIT = "byte_bpe_50k.json", 1024
#: Characters of a chunk, and how many neighbouring maps compose in one step.
CHUNK, FAN = 1 << 16, 64
#: States that a Python worker keeps between batches: bounds the memory, not the result.
KEEP = 250_000
#: Endings that stay with their apostrophe, after its sign, as this kind of tokenizer splits them (fixed values).
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
START, LETTER, DIGIT, MARK, SPACE, QUOTE = range(6)
#: Within a word: the bytes that a token still open can hold, and for each prefix that ends among them its last token and its count, from the whole's.
Window = tuple[bytes, tuple[int, ...], tuple[int, ...]]
NOTHING: Window = b"", (-1,), (0,)


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


class Transducer:
    """States by what they hold; `start` is the state before any character."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split, model = said.get("pre_tokenizer") or {}, said["model"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        self.special = [t["content"] for t in said.get("added_tokens") or []]
        alone = all(not any(x.isspace() for x in t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in said.get("added_tokens") or [])
        apart = not any(a != b and b.startswith(a) for a in self.special for b in self.special)
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or said.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or not alone or not apart:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        tokenizer = Tokenizer.from_file(path)
        self.model, self.split = tokenizer.model, tokenizer.pre_tokenizer
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        rest = [b for b in range(256) if b not in own]
        self.sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {s: b for b, s in self.sign.items()}
        self.tokens = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.by_id = {i: t for t, i in self.tokens.items()}
        self.open = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.classes: dict[str, int] = {}
        self.sound: dict[bytes, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(START, NOTHING)

    def state(self, mode: int, window: Window, before=None, step=None, special=None) -> State:
        key = mode, window, before, step, special
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key)
        return found

    def kind(self, char: str) -> int:
        """LETTER, DIGIT, MARK or SPACE: whatever the library leaves in one piece with it."""
        if char not in self.classes:
            with_it = (k for k, beside in ((LETTER, "a"), (DIGIT, "1"), (MARK, "!")) if len(self.split.pre_tokenize_str(beside + char)) == 1)
            self.classes[char] = next(with_it, SPACE)
        return self.classes[char]

    def tokens_of(self, data: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(map(self.sign.__getitem__, data)))]

    def meet(self, before: int, token: bytes) -> bool:
        """Whether token stays as it is behind the token `before`, or behind nothing (-1)."""
        if before >= 0:
            return self.tokens_of(self.by_id[before] + token) == [before, self.tokens[token]]
        if token not in self.sound:
            self.sound[token] = self.tokens_of(token) == [self.tokens[token]]
        return self.sound[token]

    def read(self, text: str, window: Window) -> tuple[Window, int]:
        """The window after text, and the tokens added."""
        (held, last, count), n = window, 0
        for b in text.encode():
            data = held + bytes([b])
            for k in range(len(data)):
                token = data[k:]
                if token in self.tokens and self.meet(last[k], token):
                    break
            else:
                raise ValueError("no token ends here: not a byte-level vocabulary")
            added = count[k] + 1
            first = next((k for k in range(len(data)) if data[k:] in self.open), len(data))
            held, last = data[first:], (*last, self.tokens[token])[first:]
            count = tuple([n - added for n in (*count, added)[first:]])
            n += added
        return (held, last, count), n

    def count(self, text: str) -> int:
        """The tokens of a text: one transition a character."""
        state, n = self.start, 0
        for c in text:
            state, d = state[c]
            n += d
        return n


class State(dict):
    """By character: (next, tokens added). Its key: the mode, the window, in white space the last character and what that added, in QUOTE the ending so far, and what has been read of special tokens, with the tokens counted since."""

    __slots__ = ("of", "key")

    def __init__(self, of: Transducer, key: tuple):
        self.of, self.key = of, key

    def __missing__(self, char: str) -> tuple[State, int]:
        of, special = self.of, self.key[-1]
        mode, window, before, step, added = self._next(char)
        found = []
        for read, since in (*(special or ()), ("", 0)):
            read += char
            if read in of.special:
                self[char] = of.start, 1 - since
                return self[char]
            if any(s.startswith(read) for s in of.special):
                found.append((read, since + added))
        self[char] = of.state(mode, window, before, step, tuple(found) or None), added
        return self[char]

    def _begin(self, char: str) -> tuple:
        """char as the first of a word."""
        of = self.of
        kind = of.kind(char)
        window, n = of.read(char, NOTHING)
        if kind == SPACE:
            return SPACE, window, char, n, n
        return (QUOTE, window, "", None, n) if char == "'" else (kind, window, None, None, n)

    def _next(self, char: str) -> tuple:
        of, kind = self.of, self.of.kind(char)
        mode, held, before, step, _ = self.key
        if mode == QUOTE:
            ending = before + char
            if ending in ENDINGS:
                start = "'" + before
                apart = of.count("'") + (of.count(before) if before else 0)
                return START, NOTHING, None, None, of.read(start + char, NOTHING)[1] - apart
            if any(e.startswith(ending) for e in ENDINGS):  # of letters: a word until it is an ending
                window, n = of.read(char, NOTHING)
                return QUOTE, window, ending, None, n
            mode = LETTER if before else MARK
        if mode == SPACE:
            if kind == SPACE:
                window, n = of.read(char, held)
                return SPACE, window, char, n, n
            if before == " ":
                window, n = of.read(before + char, NOTHING)
                return kind, window, None, None, n - step
            alone = of.read(before, NOTHING)[1]
            *to, n = self._begin(char)
            return *to, n + alone - step
        if mode == kind:
            window, n = of.read(char, held)
            return mode, window, None, None, n
        return self._begin(char)


_machines: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This Python worker's transducer of a file, without what it knows beyond KEEP states."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    elif len(_machines[path].states) > KEEP:
        _machines[path].clear()
    return _machines[path]


#: (text up to the first place that all states leave alike, tokens from there to the last such place, text behind it); without such a place the text and None, "".
Map = tuple[str, int | None, str]


def chunk_map(machine: Transducer, text: str) -> Map:
    space = [machine.kind(c) == SPACE for c in set(text)]
    blank = {c for c, s in zip(set(text), space, strict=True) if s}
    places = (i for i in range(1, len(text)) if text[i] in blank and text[i - 1] not in blank)
    first = next(places, None)
    if first is None:
        return text, None, ""
    last = next(i for i in range(len(text) - 1, 0, -1) if text[i] in blank and text[i - 1] not in blank)
    return text[:first], machine.count(text[first:last]), text[last:]


def composed(machine: Transducer, a: Map, b: Map) -> Map:
    if b[1] is None:
        return (a[0] + b[0], None, "") if a[1] is None else (a[0], a[1], a[2] + b[0])
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    return a[0], a[1] + machine.count(a[2] + b[0]) + b[1], b[2]


def total(machine: Transducer, m: Map) -> int:
    """The tokens of the text whose map this is."""
    return machine.count(m[0]) + (m[1] or 0) + machine.count(m[2])


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _counted(texts: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts read in one go."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                rows.append((doc_id, len(text.encode()), transducer(path).count(text)))
            if rows:
                yield _arrow(rows, schema)

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


KEYS = ("doc_id", "digest")
MAPS = "doc_id long, digest string, place long, copies long, n_bytes long, head string, known long, tail string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def chunk_maps(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """The stored maps (MAPS) of each chunk of texts (doc_id, text); rows equal in both are one, with their number."""
    pieces = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("place", pa.int64()), ("chunk", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, digest in zip(*batch.columns, strict=True):
                doc_id, text, digest = doc_id.as_py(), text.as_py() or "", digest.as_py()
                for k, at in enumerate(range(0, max(1, len(text)), chunk)):
                    yield _arrow([(doc_id, digest, k, text[at : at + chunk])], pieces)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, copies, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                yield _arrow([(*(k.as_py() for k in key), copies.as_py(), len(text.encode()), *chunk_map(transducer(path), text))], _schema(MAPS))

    parts = texts.select(F.col("doc_id").cast("long"), "text", F.sha2("text", 256).alias("digest")).mapInArrow(cut, "doc_id long, digest string, place long, chunk string")
    dealt = parts.groupBy("doc_id", "digest", "place", "chunk").agg(F.count("*").alias("copies"))
    return written(dealt.select(*KEYS, "place", "copies", "chunk").mapInArrow(read, MAPS), "maps")


def scanned(maps: DataFrame, path: str, fan: int = FAN) -> list[DataFrame]:
    """The levels of the scan: maps, then the maps of `fan` neighbours together, up to one map a text."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, row in zip(*batch.columns, strict=True):
                machine, own = transducer(path), row.as_py()
                out = None
                for m in own:
                    m = m["head"], m["known"], m["tail"]
                    out = m if out is None else composed(machine, out, m)
                yield _arrow([(*(k.as_py() for k in key), own[0]["copies"], sum(m["n_bytes"] for m in own), *out)], _schema(MAPS))

    levels, longest = [maps], maps.agg(F.max("place")).first()[0] or 0
    while longest:
        row = F.struct("place", "copies", "n_bytes", "head", "known", "tail")
        groups = levels[-1].groupBy(*KEYS, F.expr(f"place div {fan}").alias("at")).agg(F.sort_array(F.collect_list(row)).alias("own"))
        levels.append(written(groups.mapInArrow(compose, MAPS), f"maps{len(levels)}"))
        longest //= fan
    return levels


def chunk_starts(levels: list[DataFrame], path: str) -> DataFrame:
    """(doc_id, digest, place, start, n_tokens) of each chunk: the tokens of the text before it, and those by which it makes the text longer.

    The way down of the scan: what is before a chunk is what is before its group, and its neighbours before it.
    """
    before = levels[-1].select(*KEYS, "place", F.lit("").alias("head"), F.lit(None).cast("long").alias("known"), F.lit("").alias("tail"))
    fan = FAN

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema("doc_id long, digest string, place long, head string, known long, tail string, n long")
        for batch in batches:
            for doc_id, digest, own, head, known, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                machine, out = transducer(path), (head or "", known, tail or "")
                for m in own:
                    after = composed(machine, out, (m["head"], m["known"], m["tail"]))
                    yield _arrow([(doc_id, digest, m["place"], *out, total(machine, after))], schema)
                    out = after

    for level in reversed(levels[:-1]):
        groups = level.groupBy(*KEYS, F.expr(f"place div {fan}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("place", "head", "known", "tail"))).alias("own"))
        up = before.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), F.col("place").alias("_at"), "head", "known", "tail")
        joined = groups.join(up, groups["doc_id"].eqNullSafe(up["_id"]) & (groups["digest"] == up["_of"]) & (groups["at"] == up["_at"]))
        before = written(joined.select(*KEYS, "own", "head", "known", "tail").mapInArrow(down, "doc_id long, digest string, place long, head string, known long, tail string, n long"), "before")
    if len(levels) == 1:
        return levels[0].limit(0).select(*KEYS, "place", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    start = F.coalesce(F.lag("n").over(W.partitionBy(*KEYS).orderBy("place")), F.lit(0))
    return before.select(*KEYS, "place", start.alias("start"), (F.col("n") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of docs (doc_id, text): short texts where they are, long ones by chunks."""
    path = path or default_path()
    long: Column = F.coalesce(F.length("text"), F.lit(0)) > chunk
    top = scanned(chunk_maps(docs.filter(long), path, chunk), path)[-1]
    schema = _schema("doc_id long, n_bytes long, n_tokens long")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, copies, n_bytes, *m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _arrow([(doc_id, n_bytes, total(transducer(path), tuple(m)))] * copies, schema)

    closed = top.select("doc_id", "copies", "n_bytes", "head", "known", "tail").mapInArrow(close, "doc_id long, n_bytes long, n_tokens long")
    return _counted(docs.filter(~long), path).unionByName(closed)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
