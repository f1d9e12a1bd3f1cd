"""Search for parts of names by an inverted index of their trigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
_LITERALS = 1000  # names that may be asked for at once


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text; a shorter text is its own, so that every name is on a list."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(runs)).otherwise(F.array(text))


@dataclass
class NameIndex:
    """Lists of names by trigram, in a folder: ``postings`` (gram, id, name, whether it begins the name), each file sorted by gram, and ``counts`` (gram, n).

    Lists are dealt out over all files, so that no file has a frequent one alone and nothing is read before to find ranges.  Names are in lower case.  A search reads the row groups of its own grams' lists alone, and verifies what it finds.
    """

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, names: DataFrame, path: str) -> NameIndex:
        """Index of names (id, name); null names are on no list, repeated rows on theirs as often."""
        lower = names.where("name is not null").select("id", F.lower("name").alias("name"))
        rows = lower.select("id", "name", F.explode(grams(F.col("name"))).alias("gram")).withColumn("head", F.startswith("name", "gram"))
        rows.repartition("gram", "id").sortWithinPartitions("gram").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        found = cls(names.sparkSession, path)
        found.postings.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
        return found

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def rarest(self, asked: list[str]) -> dict[str, str | None]:
        """For each asked text of three characters and more its trigram with the shortest list; null if one has none, so that nothing contains the text."""
        every = sorted(set().union(*map(_grams, asked))) if asked else []
        found = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(every)).collect() if every else []
        n = {r["gram"]: r["n"] for r in found}
        return {a: None if any(g not in n for g in _grams(a)) else min(_grams(a), key=lambda g: (n[g], g)) for a in asked}

    def containing(self, asked: list[str]) -> DataFrame:
        """Names that contain one of some texts (up to 1000) in any case: id, name.

        For each text the list of its rarest trigram is read.  A text shorter than a trigram is on the lists of the
        trigrams that contain it.
        """
        asked = sorted({a.lower() for a in asked})
        if len(asked) > _LITERALS:
            raise ValueError(f"more than {_LITERALS} texts")
        best = {a: g for a, g in self.rarest([a for a in asked if len(a) >= GRAM]).items() if g is not None}
        short = [a for a in asked if len(a) < GRAM]
        listed = F.col("gram").isin(sorted(set(best.values())))
        for a in short:
            listed = listed | F.contains("gram", F.lit(a))
        wanted = [*best, *short]
        hit = F.exists(F.array(*map(F.lit, wanted)), lambda a: F.contains("name", a)) if wanted else F.lit(False)
        return self.postings.where(listed).where(hit).select("id", "name").distinct()

    def within(self, texts: list[str]) -> DataFrame:
        """Names that are part of one of some texts (up to 1000) in any case: id, name.  They begin with a trigram of the text, or are shorter than one."""
        texts = sorted({t.lower() for t in texts})
        if len(texts) > _LITERALS:
            raise ValueError(f"more than {_LITERALS} texts")
        heads = {t[i : i + n] for t in texts for n in range(GRAM + 1) for i in range(len(t) - n + 1)}
        lists = self.spark.createDataFrame([(h,) for h in sorted(heads)], "gram string")
        part = F.exists(F.array(*map(F.lit, texts)), lambda t: F.contains(t, F.col("name"))) if texts else F.lit(False)
        return self.postings.where("head").join(lists, "gram").where(part).select("id", "name").distinct()
