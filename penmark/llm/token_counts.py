"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-level BPE encoding of a prefix ends in one token only: the one that,
put after the last token of the prefix before it, is a pair that the merges
leave alone. So `count[i] = count[i - len(t)] + 1`, for the single token t
that ends at i and passes this test. A worker remembers what words come to;
the counts of a text are those of its words on top of what stands before, so
questions about truncation and budgets are lookups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.bpe import _tokenizer, byte_characters
from penmark.llm.memory import give_back
from penmark.llm.session import table

LIMIT = 512
#: Characters of words that a worker remembers the count of, and the longest of these words.
KEPT_CHARACTERS = 4_000_000
LONGEST_KEPT = 200
#: Pairs of tokens that a worker remembers the test of.
KEPT_PAIRS = 400_000
#: A text is worked through in slices of about this many characters, a result in batches of about as many.
SLICE = 500_000

#: White space of Unicode. Fixed values.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Words of which a prefix is split otherwise than the whole: the apostrophe alone, then letters.
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixCounter:
    """Token counts of all prefixes, for a byte-level BPE without prefix space and normaliser."""

    def __init__(self, tokenizer_json: str):
        import ahocorasick

        self.library = _tokenizer(tokenizer_json)
        special = self.library.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in special.values())) if special else None
        as_character = byte_characters()
        as_byte = str.maketrans({c: chr(b) for b, c in as_character.items()})
        self.pieces: dict[int, str] = {}
        self.ending = ahocorasick.Automaton()
        for piece, number in self.library.get_vocab(with_added_tokens=False).items():
            if number not in special:
                self.pieces[number] = piece
                as_bytes = piece.translate(as_byte)
                self.ending.add_word(as_bytes, (number, len(as_bytes)))
        self.ending.make_automaton()
        low = [chr(i) for i in range(0x180)]
        letter = "".join(c for c in low if c.isalpha())
        number = "".join(c for c in low if c.isnumeric())
        self.pattern = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        )
        self.beyond = re.compile("[^\x00-ſ]")
        self.run = re.compile(f"[{_SPACE}]{{2,}}(?=[^{_SPACE}])")
        self.cut = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
        self.totals: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.kept = 0

    def split(self, text: str) -> list[str]:
        """The pieces of ordinary text that no token crosses."""
        if text.isascii() or not self.beyond.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _stays(self, a: int, b: int) -> bool:
        """Whether the merges leave the pair of tokens as it is."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fits = [t.id for t in self.library.model.tokenize(self.pieces[a] + self.pieces[b])] == [a, b]
        self.pairs[a << 32 | b] = fits
        return fits

    def word_counts(self, word: str) -> list[int]:
        """Counts at the end of each character of a word, itself one piece of a text."""
        raw = word if word.isascii() else word.encode().decode("latin-1")
        count, last = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        known, done = self.pairs.get, -1
        for end, (token, length) in self.ending.iter(raw):
            if end == done:  # one token only can end here
                continue
            start = end + 1 - length
            if start:
                fits = known(last[start] << 32 | token)
                if fits is None:
                    fits = self._stays(last[start], token)
                if not fits:
                    continue
            count[end + 1], last[end + 1], done = count[start] + 1, token, end
        if raw is not word:
            return [count[e] for e in np.cumsum([len(c.encode()) for c in word])]
        if word in _LONG_CONTRACTIONS:
            return [1, 2, count[3]]
        return count[1:]

    def word_total(self, word: str) -> int:
        total = self.word_counts(word)[-1]
        if len(word) <= LONGEST_KEPT:
            self.kept += len(word)
            if self.kept > KEPT_CHARACTERS:
                self.totals.clear()
                self.kept = len(word)
            self.totals[word] = total
        return total

    def _slices(self, text: str) -> Iterator[str]:
        """An ordinary text in slices that end between a word and white space, where no piece goes on."""
        start = 0
        while start < len(text):
            cut = self.cut.search(text, start + SLICE) if len(text) - start > SLICE else None
            end = cut.start() if cut else len(text)
            yield text[start:end]
            start = end

    def _slice_counts(self, text: str) -> np.ndarray:
        """Counts of an ordinary text at the end of each character."""
        found = [self.word_counts(w) for w in self.split(text)]
        ends = np.cumsum([0, *(f[-1] for f in found)])
        counts = np.concatenate([np.array(f) + e for f, e in zip(found, ends, strict=False)])
        for run in self.run.finditer(text):
            # As the end of a prefix a run of white space is one piece; before a word its last character belongs elsewhere.
            a, b = run.span()
            counts[b - 1] = (counts[a - 1] if a else 0) + self.word_counts(text[a:b])[-1]
        return counts

    def _slice_total(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of an ordinary text, and the most characters of a prefix of at most `budget` >= 0 tokens."""
        known, words = self.totals.get, self.split(text)
        totals = [known(w) or self.word_total(w) for w in words]
        total = sum(totals)
        if total <= budget:
            return total, len(text)
        before = np.cumsum([0, *totals])
        first = int(np.searchsorted(before, budget, side="right")) - 1
        # A piece starts here whatever stands before it, but for the last character of white space.
        first -= bool(first and words[first - 1].isspace())
        counts = self._slice_counts("".join(words[first : first + 4])) + before[first]
        within = np.flatnonzero(counts <= budget)
        return total, sum(map(len, words[:first])) + (int(within[-1]) + 1 if within.size else 0)

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """Ordinary texts, each with the special token after it; the last has none."""
        start = 0
        for found in self.special.finditer(text) if self.special else ():
            yield text[start : found.start()], found[0]
            start = found.end()
        yield text[start:], ""

    def counts(self, text: str) -> Iterator[np.ndarray]:
        """Counts at the end of each character, in order, in several arrays.

        A special token that the text spells out counts as one; what it has of
        it before its last character is ordinary text.
        """
        base = 0
        for part, special in self._parts(text):
            done, at_end = 0, base
            for piece in self._slices(part + special[:-1]):
                counts = self._slice_counts(piece) + (base if not done else int(last))
                last = counts[-1]
                if done < len(part) <= done + counts.size:
                    at_end = int(counts[len(part) - done - 1])
                done += counts.size
                yield counts
            base = at_end + bool(special)
            if special:
                yield np.array([base])

    def total(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the most characters of a prefix of at most `budget` tokens."""
        tokens, position, fit = 0, 0, 0
        for part, special in self._parts(text):
            if special and tokens <= budget:
                seen, start = tokens, position
                for piece in self._slices(part + special[:-1]):
                    if seen <= budget:
                        n, chars = self._slice_total(piece, budget - seen)
                        fit, seen, start = start + chars, seen + n, start + len(piece)
            for piece in self._slices(part):
                n, chars = self._slice_total(piece, max(0, budget - tokens))
                if tokens <= budget and not special:
                    fit = position + chars
                tokens, position = tokens + n, position + len(piece)
            if special:
                tokens, position = tokens + 1, position + len(special)
                fit = position if tokens <= budget else fit
        return tokens, fit


@cache
def _counter(tokenizer_json: str) -> PrefixCounter:
    return PrefixCounter(tokenizer_json)


def token_counts(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    budget: int = LIMIT,
    with_counts: bool = False,
) -> DataFrame:
    """Token counts of each text, as the library encodes it without adding special tokens.

    Returns a row for each row of `documents`: id_col, n_bytes (UTF-8, long),
    n_tokens (long), over_limit (n_tokens > budget), fit_chars (long: the most
    characters that a prefix of at most `budget` tokens has; as counts can fall
    where a piece is completed, longer prefixes than the first that is too long
    are looked at), and on request counts (array of int: at place i, from 0,
    the tokens of the first i characters). A null text is an empty one: no
    bytes, no tokens, counts [0]. Repeated rows and null ids count like all
    others; further columns are not read. No rows move between tasks, and of a
    long text one slice is held at a time, unless counts are asked for.
    """
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())
    source = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars", *["counts"] * with_counts]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)

        def flush(keys: pa.Array, rows: list[tuple], kept: list[np.ndarray]) -> pa.RecordBatch:
            sizes, tokens, fits = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            columns = [keys, sizes, tokens, pa.array([r[1] > budget for r in rows]), fits]
            if with_counts:
                ends = np.cumsum([0, *(k.size for k in kept)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(ends, np.concatenate(kept).astype(np.int32)))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            first, rows, kept, held = 0, [], [], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                rows.append((len(text.encode()), *counter.total(text, budget)))
                if with_counts:
                    kept.append(np.concatenate([[0], *counter.counts(text)]))
                    held += len(text)
                if held > SLICE:
                    yield flush(batch.column(0).slice(first, len(rows)), rows, kept)
                    first, rows, kept, held = i + 1, [], [], 0
            if rows:
                yield flush(batch.column(0).slice(first), rows, kept)
        give_back()

    types = f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", counts array<int>" * with_counts
    return source.mapInArrow(counted, types).withColumnRenamed("id", id_col)


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` characters; those of the whole text where it has fewer."""
    chars = chars if isinstance(chars, Column) else F.lit(chars)
    return F.get(counts, F.greatest(F.lit(0), F.least(chars, F.size(counts) - 1)).cast("int"))


def fitting_prefix(counts: Column, budget: Column | int) -> Column:
    """The most characters that a prefix of at most `budget` tokens has; null for a negative budget."""
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
