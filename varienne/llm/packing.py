"""Vector bin packing of token sequences."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import renamed

LENGTH = 4096
#: Most examples in one sequence.
SEGMENTS = 512
#: Examples that one task looks at together.
GROUP = 4096
END = 2

PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"


def pack_group(lengths: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Place examples, cut where needed, in sequences under three limits.

    Returns pieces (example, start, length, sequence, offset) and the fill of every sequence.  The
    demand of a piece is (tokens, 1 segment, loss-bearing tokens), each as a share of its limit.  The
    open sequence takes, of all waiting remainders that fit, the one whose demand has the largest dot
    product with what is still free; if none fits, the one with the largest dot product after cutting
    is cut to fill the rest.  ``loss[i]`` bearing tokens stand at the end of example i.
    """
    most, segments, bearing = limits
    start = np.zeros(len(lengths), np.int64)
    rest = lengths.astype(np.int64).copy()
    loss = np.minimum(loss, lengths).astype(np.int64)
    waiting = rest > 0
    pieces, fills = [], []
    while waiting.any():
        free, slots, free_loss, fill = most, segments, bearing, 0
        while free and slots and waiting.any():
            at = np.flatnonzero(waiting)
            # Prompt tokens come first, so a cut to n tokens bears loss only past the prompt.
            prompt = np.maximum(rest[at] - np.minimum(loss[at], rest[at]), 0)
            take = np.minimum(np.minimum(rest[at], free), prompt + free_loss)
            whole = take == rest[at]
            dot = take / most * (free / most) + slots / segments / segments + np.maximum(take - prompt, 0) / bearing * (free_loss / bearing)
            dot = np.where(take > 0, dot + 4.0 * whole, -1.0)
            best = int(np.argmax(dot))
            if dot[best] < 0:
                break
            i, n = int(at[best]), int(take[best])
            pieces.append((i, int(start[i]), n, len(fills), fill))
            free_loss -= max(n - int(prompt[best]), 0)
            start[i] += n
            rest[i] -= n
            waiting[i] = rest[i] > 0
            free, slots, fill = free - n, slots - 1, fill + n
        fills.append(fill)
    return pieces, np.array(fills, np.int64)


def power_parts(fill: int) -> list[int]:
    """A fill as falling powers of two: sequences that need no padding."""
    return [1 << b for b in reversed(range(fill.bit_length())) if fill >> b & 1]


def without_padding(pieces, fills, most: int):
    """Cut sequences that are not full into sequences of a power of two."""
    out, base, by = [], 0, {}
    for p in pieces:
        by.setdefault(p[3], []).append(p)
    for s, fill in enumerate(fills):
        sizes = [int(fill)] if fill == most else power_parts(int(fill))
        ends = np.cumsum(sizes)
        for i, start, n, _, offset in by.get(s, []):
            while n:
                part = int(np.searchsorted(ends, offset, "right"))
                begin = int(ends[part]) - sizes[part]
                step = min(n, int(ends[part]) - offset)
                out.append((i, start, step, base + part, offset - begin))
                start, offset, n = start + step, offset + step, n - step
        base += len(sizes)
    return out, base


class Encoder:
    """Token ids of texts: every distinct word is encoded once and then looked up.

    White space ends a word for this tokenizer family and leaves no token, so the ids of a text are
    those of its words in order.
    """

    #: Words remembered between batches and, where a worker process is used again, between tasks.
    REMEMBERED = 800_000

    def __init__(self, path: str):
        import sys

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Kept on an installed module, because functions of this one arrive anew with every task.
        self.known = sys.modules["tokenizers"].__dict__.setdefault("_known_words", {}).setdefault(path, {})
        letters = [chr(i) for i in range(0x41, 0x180) if chr(i).isalpha() and len(self.tokenizer.normalizer.normalize_str(chr(i))) == 1]
        self.letters = {ord(c): "".join(x for x, _ in self._split(c)) for c in letters}
        self.plain = re.compile(f"([{''.join(letters)}]+)([.,!]*)")

    def _split(self, word: str) -> list:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))

    def _word(self, word: str) -> list[int]:
        plain, tokenize = self.plain.fullmatch(word), self.tokenizer.model.tokenize
        if plain:  # Latin letters and closing marks: each letter folds alone, and the marks split off
            return [t.id for part in (plain[1].translate(self.letters), plain[2]) if part for t in tokenize(part)]
        if "<|" in word:  # may hold a special token
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [t.id for part, _ in self._split(word) for t in tokenize(part)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text in them."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if not len(lists):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.known[distinct[i]] = self._word(distinct[i])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], n)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return flat[at], ends[offsets - offsets[0]]


def pack_tasks(path: str, limits: tuple[int, int, int], group: int, end: int):
    """Function for ``mapInArrow``: (id, text, prompt) to pieces."""

    def run(batches):
        from pyspark import TaskContext

        encode = Encoder(path)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        sequence = task << 40
        held: list[tuple] = []

        def packed():
            nonlocal sequence
            lengths = np.array([len(x[1]) for x in held], np.int64)
            pieces, fills = pack_group(lengths, lengths - np.array([x[2] for x in held], np.int64), limits)
            pieces, used = without_padding(pieces, fills, limits[0])
            rows = []
            for i, start, n, s, offset in pieces:
                id_, ids, prompt = held[i]
                bearing = max(start + n - max(start, prompt), 0)
                rows.append((id_, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), bearing, sequence + s, offset))
            sequence += used
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 8, names=names)

        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                ids, bounds = encode(part.column(1))
                prompts = prompt_bounds = None
                prompt_sizes = np.zeros(len(part), np.int64)
                if part.column(2).null_count < len(part):
                    prompts, prompt_bounds = encode(part.column(2))
                    prompt_sizes = np.diff(prompt_bounds)
                for i, id_ in enumerate(part.column(0).to_pylist()):
                    pre = prompts[prompt_bounds[i]:prompt_bounds[i + 1]] if prompts is not None else np.zeros(0, np.uint32)
                    held.append((id_, np.concatenate([pre, ids[bounds[i]:bounds[i + 1]], np.array([end], np.uint32)]).astype("<u4"), int(prompt_sizes[i])))
                if len(held) >= group:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return run


def pack_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, length: int = LENGTH,
                   segments: int = SEGMENTS, loss_tokens: int | None = None, group: int = GROUP, end: int = END) -> DataFrame:
    """Pack examples into sequences under limits on tokens, segments and loss-bearing tokens.

    Returns a row per piece: id_col, start (its example's tokens before it), length, ids_crc32,
    doc_tokens, loss_tokens, sequence_id and offset.  An example is its prompt, its text and the id
    ``end``; only tokens after the prompt bear loss (all of them without ``prompt_col``), at most
    ``loss_tokens`` of them per sequence (default: ``length``).  ``tokenizer`` is the path of a file
    that every executor can read, of a tokenizer for which white space separates words and has no ids.

    Each task packs the examples of its input split in groups of ``group`` by the dot-product
    heuristic, without a shuffle.  Examples are cut where that fills a sequence; what is left of a
    group falls into sequences whose sizes are powers of two, so nothing is padded.  Sequence ids are the
    task's number times 2**40 plus a counter; a task that runs again makes the same ids.

    Null or empty texts hold the end id alone.  Null ids are packed like others; rows that repeat an id
    are examples of their own.  An empty table gives no pieces.  Texts of any length are cut into as many pieces as they need.  Other columns are ignored.
    """
    prompt = F.col(f"`{prompt_col}`") if prompt_col else F.lit(None).cast("string")
    source = renamed(docs.withColumn(" prompt", prompt), id_col, text_col, " prompt", to=("id", "text", "prompt")).withColumn("id", F.col("id").cast("bigint"))
    limits = (length, segments, loss_tokens or length)
    return source.mapInArrow(pack_tasks(tokenizer, limits, group, end), PIECES).withColumnRenamed("id", id_col)
