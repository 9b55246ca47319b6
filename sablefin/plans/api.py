"""The library's front door: what a caller does with a table of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sablefin.errors import PatternError
from sablefin.functions.patterns import LIBRARY, PatternSet, default_pii, with_custom
from sablefin.operators import detect, features, score, tokenise
from sablefin.sources import tables


class Sablefin:
    """A library of patterns and what can be done with it."""

    def __init__(self, spark: SparkSession, patterns: PatternSet | None = None, threshold: float = detect.THRESHOLD):
        self.spark, self.patterns, self.threshold = spark, patterns or default_pii(), threshold
        self.library = dict(LIBRARY)

    def add_pattern(self, pattern_type: str, regex: str) -> None:
        """Add a regex to a kind; raises :class:`PatternError` if it does not compile."""
        try:
            self.spark.range(1).select(F.regexp_count(F.lit(""), F.lit(regex))).collect()
        except PySparkException as e:
            raise PatternError(f"{pattern_type}: {regex}") from e
        self.library = with_custom(self.library, pattern_type, regex)

    def detect(self, df: DataFrame, key: str, rows: int = detect.SAMPLE_ROWS) -> DataFrame:
        """Kinds of personal data in a sample of records, those above the threshold, ranked."""
        return detect.recommend(detect.detect_source(df, key, rows, self.library), self.threshold)

    def detect_columns(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """What each column holds, from all rows."""
        return detect.detect_columns(df, columns or df.columns, self.library)

    def obfuscate(self, df: DataFrame, key: str, text_column: str | list[str] | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The table with its text tokenised, and the dictionary that leads back.

        All the columns named are tokenised, or, without names, all text columns but the key. ``known`` is a dictionary that
        was kept: its originals keep their tokens.
        """
        names = [text_column] if isinstance(text_column, str) else text_column or [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name != key]
        features.require_columns(df, names)
        tokens = tokenise.record_dictionary(df, key, names, self.patterns)
        tokens = tokens if known is None else tokenise.merged_dictionary(known, tokens)
        tokens = tokens.withColumn("token", tokenise.counter_token(F.col("pattern_type"), F.col("number")))
        return tokenise.tokenise_columns(df, key, names, tokens, self.patterns), tokens

    def restore(self, df: DataFrame, key: str, text_column: str | list[str], tokens: DataFrame) -> DataFrame:
        """The table with its tokens replaced by what they stand for."""
        for name in [text_column] if isinstance(text_column, str) else text_column:
            df = tokenise.detokenise(df, key, name, tokens)
        return df

    def profile(self, df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
        """Columns by how much they look like prose worth analysing."""
        names = columns or [c for c in df.columns if c != key]
        features.require_columns(df, names)
        return features.profile(tables.long_form(df, key, names))

    def analyse(self, df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
        """Sentiment of each chosen column (those whose names say they are prose, if none are given) of each record."""
        names = columns or features.auto_discover(df.columns)
        features.require_columns(df, names)
        return score.multi_field(df, key, names)

    def score(self, df: DataFrame, text_column: str, scorer: Callable[[list[str]], list[float]], **limits: float) -> DataFrame:
        """``df`` with the scores of an outside scorer, which sees tokenised text alone, however long a text is and however many
        matches it has. Rows stay as they are, repeated ones too.

        All that this object's patterns and any regex of its library match is replaced, the patterns first, in order of
        priority.
        """
        rules = [(p.pattern_type, p.regex) for p in self.patterns.active().by_priority()]
        rules += [(kind, regex) for kind, regexes in self.library.items() for regex in regexes if (kind, regex) not in rules]
        concealed = tokenise.hidden(df.withColumn("__hidden", F.col(text_column)), "__hidden", rules)
        return score.with_scorer(concealed, "__hidden", scorer, **limits).drop("__hidden")
