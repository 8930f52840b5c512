"""BPE encoding and decoding with a pair occurrence index.

A text is cut into parts by the vocabulary file's own rules; merges never cross a part, and a distinct
part is encoded once per worker.  The new parts of a batch are laid out one after another and merged
together through an index from each pair's rank to all positions where that pair starts.  Ranks are taken
in ascending order.  At a rank's positions, from left to right, the pair becomes one symbol; the pairs
that start there and just before have changed, so these positions move to the lists of their new ranks.
A position on an outdated list is recognised by its present rank.

A text of ASCII and Latin letters is split by the file's pattern over the whole text.  Any other text is
cut at white space, which the file's rules must drop, and its other words are normalised and split by the
tokenizers library.  Merging and decoding are done here.

A null text is empty; repeated rows give equal rows; an empty table gives an empty one; null ids stay null;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes and number of the parts that a worker remembers; beyond either it starts afresh (only a cache).
REMEMBERED_BYTES, REMEMBERED = 32 << 20, 600_000
_BITS, _NONE = 32, np.int64(1) << 40
#: Characters of a text that needs no normalising but lower case, which stays among them: ASCII and composed Latin letters.
_LATIN = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xC0, 0x180)) if c != 0x130]
_PLAIN = re.compile("[\t-\r -~\u00c0-\u012f\u0131-\u017f]*")
_WORD = re.compile("[^\t-\r ]+")


def _byte_marks() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class PairIndexEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs, first = np.unique([self.vocabulary[x] << _BITS | self.vocabulary[y] for x, y in merges] or [-1], return_index=True)
        self.pairs, self.rank_of = pairs.astype(np.int64), first.astype(np.int64)
        self.merged = np.array([self.vocabulary[x + y] for x, y in merges] or [0], np.int64)
        self.tokens = {i: t for t, i in {**self.vocabulary, **self.special}.items()}
        marks = _byte_marks()
        self.inner = np.array([self.vocabulary.get(m, -1) for m in marks], np.int64)
        self.last = np.array([self.vocabulary.get(m + self.suffix, -1) for m in marks], np.int64)
        self.pattern = self._pattern(spec)
        if [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str("a b")] != ["a", "b"]:
            raise ValueError("the vocabulary's rules keep white space, at which texts are cut here")

    @staticmethod
    def _pattern(spec: dict) -> re.Pattern | None:
        """The splitting rule over plain texts, as an expression over their alphabet; None if the file has rules of another form."""
        kinds = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        rules = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or len(rules) != 2 or rules[0]["type"] != "Split" or rules[0]["behavior"] != "Removed" or not rules[0]["invert"]:
            return None
        if rules[1] | {"trim_offsets": True} != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}:
            return None
        text = rules[0]["pattern"].get("Regex", "")
        for kind in "LN":
            text = text.replace(f"\\p{{{kind}}}", "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind))
        return re.compile(text) if text and "\\p" not in text else None

    def parts(self, text: str) -> list[str]:
        """The parts of a text as keys: a lower-cased part, or a blank and a word that the library has to split."""
        plain = self.pattern is not None and not (self.splitter and self.splitter.search(text))
        if plain and _PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        out = []
        for word in _WORD.findall(text):
            if plain and _PLAIN.fullmatch(word):
                out += self.pattern.findall(word.lower())
            else:
                out.append(" " + word)
        return out

    def symbols(self, word: str) -> list[list[int]]:
        """The initial symbols of each part that the library makes of a word; a special token is a part by itself."""
        out = []
        for segment in self.splitter.split(word) if self.splitter else [word]:
            if segment in self.special:
                out.append([self.special[segment]])
            elif segment:
                if self.library.normalizer is not None:
                    segment = self.library.normalizer.normalize_str(segment)
                for part, _ in self.library.pre_tokenizer.pre_tokenize_str(segment):
                    marks = [*part[:-1], part[-1] + self.suffix] if part else []
                    out.append([i for i in map(self.vocabulary.get, marks) if i is not None])
        return out

    def _laid_out(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all keys in order, whether one starts a part, and the first symbol of each key (with a last entry: all)."""
        plain = [k for k in keys if k[0] != " "]
        raw = [k.encode() for k in plain]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, ends = self.inner[data], np.cumsum(size)
        ids[ends - 1] = self.last[data[ends - 1]]
        start = np.zeros(len(ids), bool)
        start[ends - size] = True
        if len(plain) < len(keys):
            whole, begins, at, sizes = [], [], 0, iter(size.tolist())
            lengths = np.empty(len(keys), np.int64)
            for n, key in enumerate(keys):
                if key[0] != " ":
                    lengths[n] = k = next(sizes)
                    whole.append(ids[at : at + k])
                    begins.append(start[at : at + k])
                    at += k
                    continue
                own = [p for p in self.symbols(key[1:]) if p]
                lengths[n] = sum(map(len, own))
                whole.append(np.array([i for p in own for i in p], np.int64))
                begins.append(np.array([j == 0 for p in own for j in range(len(p))], bool))
            ids, start, size = np.concatenate(whole), np.concatenate(begins), lengths
        known = ids >= 0
        if not known.all():  # a byte that the vocabulary lacks is dropped
            owner = np.repeat(np.arange(len(keys)), size)[known]
            part = np.cumsum(start)[known]
            ids, size = ids[known], np.bincount(owner, minlength=len(keys))
            start = np.concatenate([[True], part[1:] != part[:-1]])[: len(ids)]
        return ids, start, np.concatenate([[0], np.cumsum(size)])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _BITS | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank_of[at], _NONE)

    def merge(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Merges ``ids`` in place, parts apart; returns which positions are left."""
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.append(start[1:], True)[:n]
        after[last], before[start] = -1, -1
        rank = np.full(n, _NONE)
        inside = np.flatnonzero(~last)
        rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        active = inside[rank[inside] != _NONE]
        left = np.ones(n, bool)

        def listed(at: np.ndarray):
            """(rank, positions) of each rank that occurs at the given positions."""
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            return zip(own[cut].tolist(), np.split(at, cut[1:]), strict=True)

        index: dict[int, list[np.ndarray]] = {r: [at] for r, at in listed(active)} if len(active) else {}
        order = list(index)  # ascending, so a heap already
        while order:
            r = heapq.heappop(order)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                # Two positions of which the second follows the first overlap: from the left, every second one of such a run applies.
                run = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]))
                if len(run) < len(at):
                    at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            further = after[gone]
            ids[at] = self.merged[r]
            after[at], left[gone], rank[gone] = further, False, _NONE
            rank[at] = _NONE
            has = further >= 0
            before[further[has]] = at[has]
            earlier = before[at]
            changed = np.concatenate([at[has], earlier[earlier >= 0]])
            if not len(changed):
                continue
            new = self._ranks(ids[changed], ids[after[changed]])
            rank[changed] = new
            for k, positions in listed(changed[new != _NONE]) if (new != _NONE).any() else ():
                if k in index:
                    index[k].append(positions)
                else:
                    index[k] = [positions]
                    heapq.heappush(order, k)
        return left

    def encode(self, keys: list[str]) -> list[np.ndarray]:
        """Ids of each part."""
        if not keys:
            return []
        ids, start, first = self._laid_out(keys)
        left = self.merge(ids, start)
        cuts = np.concatenate([[0], np.cumsum(left)])[first].tolist()
        flat = ids[left].astype("<u4")
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids) -> str:
        """As the library does for a file without a decoder: the tokens' strings joined by spaces."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Remembered:
    """Ids and decoded text of every distinct part met so far."""

    def __init__(self, path: str):
        self.encoder = PairIndexEncoder(path)
        self.tokens = {i: t.encode() for i, t in self.encoder.tokens.items()}
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.decoded: list[bytes] = []
        self.held = 0

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The parts of each text by their numbers, all of them known afterwards."""
        if self.held > REMEMBERED_BYTES or len(self.number) > REMEMBERED:
            self._forget()
        number, out = self.number, []
        for text in texts:
            parts = self.encoder.parts(text)
            for part in set(parts).difference(number):
                number[part] = len(number)
            out.append(np.fromiter(map(number.__getitem__, parts), np.int32, len(parts)))
        new = list(number)[len(self.ids) :] if len(number) > len(self.ids) else []
        flat = self.encoder.encode(new)
        for part, ids in zip(new, flat, strict=True):
            self.ids.append(ids.tobytes())
            self.decoded.append(b" ".join([self.tokens[i] for i in ids.tolist()]))
            self.held += len(part) + len(self.ids[-1]) + len(self.decoded[-1])
        return out


_workers: dict[str, Remembered] = {}


#: Bytes of texts whose new parts share one index, unless a single text is longer.
_INDEXED = 8 << 20


def _spans(texts: pa.Array):
    """Slices of rows of about ``_INDEXED`` bytes."""
    size = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        until = min(max(at + 1, int(np.searchsorted(size, size[at] + _INDEXED, "right")) - 1), len(texts))
        yield at, until
        at = until


def _strings(texts: pa.Array, at: int, until: int) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts[at:until].to_pylist()]


def digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""

    def run(batches):
        worker = _workers.get(vocabulary) or _workers.setdefault(vocabulary, Remembered(vocabulary))
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.binary())
            for at, until in _spans(texts):
                for numbers in worker.numbers(_strings(texts, at, until)):
                    numbers = numbers.tolist()
                    ids = b"".join(map(worker.ids.__getitem__, numbers))
                    decoded = b" ".join(filter(None, map(worker.decoded.__getitem__, numbers)))
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)


def encoded(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""

    def run(batches):
        worker = _workers.get(vocabulary) or _workers.setdefault(vocabulary, Remembered(vocabulary))
        for batch in batches:
            texts, ids = batch.column(1).cast(pa.binary()), []
            for at, until in _spans(texts):
                for numbers in worker.numbers(_strings(texts, at, until)):
                    ids.append(np.frombuffer(b"".join(map(worker.ids.__getitem__, numbers.tolist())), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)
