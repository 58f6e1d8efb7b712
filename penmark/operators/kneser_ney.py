"""An interpolated modified Kneser-Ney trigram model as tables.

The highest order has counts, the lower ones continuation counts: of how many
different words a sequence was seen after. All are aggregations of one table of
distinct trigrams. Words are told by 64-bit hashes. Trigrams are dealt out by
their middle word, so all that an order needs of a trigram's neighbours, but the
lowest order's probabilities of words, meets it without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.functions import text as T

#: Stands before the first word of a text; no word is empty.
START = ""
#: Tables of at most this many rows are sent to all tasks.
BROADCAST_ROWS = 300_000
#: Hashes of a trigram's words, in order.
WORDS = ("w1", "w2", "w3")


def _trigrams(words: Column) -> Column:
    """array<struct<pos,w1,w2,w3>>: the hash of each word after those of the two before it, which the first of a text lack."""
    padded = F.concat(F.array(F.xxhash64(F.lit(START)), F.xxhash64(F.lit(START))), F.transform(words, lambda w: F.xxhash64(w)))
    return T.bind(padded, lambda p: F.transform(T.places(0, F.size(p) - 2), lambda i: F.struct(i.alias("pos"), *[F.get(p, i + k).alias(w) for k, w in enumerate(WORDS)])))


def _places(units: DataFrame, text_col: str, *kept: str) -> DataFrame:
    return units.select(*kept, F.explode(_trigrams(T.words(F.coalesce(F.col(text_col), F.lit(""))))).alias("t"))


@dataclass(frozen=True)
class Order:
    """grams (hashes of words, n); contexts (hashes of words, total, n1, n2, n3: types seen once, twice, more); discounts of such types."""

    grams: DataFrame
    contexts: DataFrame
    discounts: tuple[float, float, float]

    def discount(self, n: Column) -> Column:
        d = [F.lit(x) for x in self.discounts]
        return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Of sequences counted once, twice and more, from how many there are of each; 0.5 where they are too few to tell."""
    row = grams.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [row[f"n{k}"] for k in range(1, 5)]
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


def _order(grams: DataFrame, k: int) -> Order:
    """Order k, 0 the highest; the context of the lowest is one row."""
    contexts = grams.groupBy(*WORDS[k:-1]).agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3")
    )
    return Order(grams, contexts, _discounts(grams))


@dataclass(frozen=True)
class KneserNey:
    """Orders from the highest down, and how many different words there are, one unknown included."""

    orders: tuple[Order, ...]
    vocabulary: int

    @classmethod
    def count(cls, corpus: DataFrame, text_col: str = "text") -> KneserNey:
        """The model of a corpus of a-z words. A null text has none; an empty corpus gives a model that knows the unknown word only."""
        places = _places(corpus, text_col).select(*[F.col(f"t.{w}").alias(w) for w in WORDS])
        grams = places.repartition("w2").groupBy(*WORDS).agg(F.count("*").alias("n")).persist()
        return cls.of_counts([grams, lower := grams.groupBy("w2", "w3").agg(F.count("*").alias("n")), lower.groupBy("w3").agg(F.count("*").alias("n")).persist()])

    @classmethod
    def of_counts(cls, grams: Sequence[DataFrame]) -> KneserNey:
        """The model of stored tables (hashes of words, n), from the highest order down."""
        return cls(tuple(_order(own, k) for k, own in enumerate(grams)), grams[-1].count() + 1)

    def release(self) -> None:
        """Frees the counted tables."""
        for order in self.orders:
            order.grams.unpersist()

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """`grams` (distinct trigrams of two context words and a word, with spaces between, as column gram) with p, the word's probability after its context."""
        own = F.split("gram", " ")
        return self._chained(grams.select("gram", *[F.xxhash64(F.get(own, F.lit(i))).alias(w) for i, w in enumerate(WORDS)])).select("gram", "p")

    def _chained(self, rows: DataFrame) -> DataFrame:
        """`rows` (distinct trigrams of any text as hashes of their words) with p, by joins with the orders."""
        p = F.lit(1.0 / self.vocabulary)
        for k, order in reversed(list(enumerate(self.orders))):
            own = order.grams.select(*WORDS[k:], F.col("n").alias(f"n{k}"))
            context = order.contexts.select(*WORDS[k:-1], F.struct("total", "n1", "n2", "n3").alias(f"s{k}"))
            rows = rows.join(self._sent(own), list(WORDS[k:]), "left")
            rows = rows.join(self._sent(context), list(WORDS[k:-1]), "left") if k < 2 else rows.crossJoin(F.broadcast(context))
            n, s = F.coalesce(f"n{k}", F.lit(0)), F.col(f"s{k}")
            d = order.discounts
            rest = (d[0] * s["n1"] + d[1] * s["n2"] + d[2] * s["n3"]) / s["total"]
            p = F.when(F.coalesce(s["total"], F.lit(0)) == 0, p).otherwise((n - order.discount(n)) / s["total"] + rest * p)
        return rows.withColumn("p", p)

    def seen(self) -> DataFrame:
        """(gram: hash of the three words, p) of every counted trigram.

        Its probability is own + rest * (that of its last word alone). Counts
        stay where they were dealt by middle word; only the last word's are
        joined, by all tasks or by a shuffle if there are many words.
        """
        first, second, third = self.orders
        total = lambda *by: F.sum("n").over(Window.partitionBy(*by))
        rows = first.grams.select(
            *WORDS, ((F.col("n") - first.discount(F.col("n"))) / total("w2", "w1")).alias("k0"), (F.sum(first.discount(F.col("n"))).over(Window.partitionBy("w2", "w1")) / total("w2", "w1")).alias("r0")
        )
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("w2", "w3")))
        middle = second.grams.groupBy("w2").agg(F.sum("n").alias("total"), F.sum(second.discount(F.col("n"))).alias("left"))
        rows = rows.join(middle, "w2").select(
            F.xxhash64(*WORDS).alias("gram"), "w3",
            (F.col("k0") + F.col("r0") * (F.col("n") - second.discount(F.col("n"))) / F.col("total")).alias("own"), (F.col("r0") * F.col("left") / F.col("total")).alias("rest"),
        )
        whole = third.grams.agg(F.sum("n").alias("total"), F.sum(third.discount(F.col("n"))).alias("left")).first()
        if not whole["total"]:
            return rows.select("gram", F.lit(1.0).alias("p"))
        alone = third.grams.select("w3", ((F.col("n") - third.discount(F.col("n"))) / whole["total"] + whole["left"] / whole["total"] / self.vocabulary).alias("alone"))
        return rows.join(self._sent(alone), "w3").select("gram", (F.col("own") + F.col("rest") * F.col("alone")).alias("p"))

    @staticmethod
    def _sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def token_surprisals(units: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """(id, pos, surprisal) of every word, in nats; texts without words have no rows.

    If the texts are `counted`, that is of the model's corpus, their trigrams
    are among those that it has seen, and no other is looked for.
    """
    places = _places(units, text_col, id_col)
    words = [F.col(f"t.{w}").alias(w) for w in WORDS]
    known = model.seen() if counted else model._chained(places.select(*words).distinct()).select(F.xxhash64(*WORDS).alias("gram"), "p")
    keyed = places.select(id_col, "t.pos", F.xxhash64(*[F.col(f"t.{w}") for w in WORDS]).alias("gram"))
    return keyed.join(known, "gram").select(id_col, "pos", (-F.log("p")).alias("surprisal"))


def text_surprisals(units: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """(id, n, mean_surprisal, perplexity) of every text with words."""
    each = token_surprisals(units, model, id_col, text_col, counted)
    means = each.groupBy(id_col).agg(F.count("*").alias("n"), F.avg("surprisal").alias("mean_surprisal"))
    return means.select("*", F.exp("mean_surprisal").alias("perplexity"))
