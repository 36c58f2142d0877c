"""The extension surface: functions by name for SQL, rewards with a fixed result, retrieval tools as table functions."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from agentlake.functions import numbers, structured


#: As in ``operators.retrieval``.
MOST_RESULTS, MOST_LINES = 20, 400


class Lines:
    """SQL table function: lines_of(text) -> (line_no, line)."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for n, line in enumerate((text or "").splitlines(), 1):
            yield n, line


def _needs(table: AnalyzeArgument, wanted: StructType) -> StructType:
    """The schema ``wanted``, whose columns the table argument must have."""
    held = set(table.dataType.fieldNames()) if table.isTable else set()
    missing = [f.name for f in wanted if f.name not in held]
    if missing:
        raise ValueError(f"the table needs the columns {', '.join(missing)}")
    return wanted


#: Made without a session, as ``analyze`` runs in a worker.
LINES = StructType().add("file_name", "string").add("line_no", "integer").add("line", "string")


class Grep:
    """SQL table function: grep_lines(TABLE(lines), pattern) -> lines that hold the pattern, case aside."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_needs(lines, LINES))

    def eval(self, row: Row, pattern: str) -> Iterator[tuple]:
        if row["line"] is not None and pattern.lower() in row["line"].lower():
            yield row["file_name"], row["line_no"], row["line"]


class ReadLines:
    """SQL table function: read_lines(TABLE(lines), file_name, start, count) -> count lines (1 to 400) from start, counted from 0."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, file_name: AnalyzeArgument, start: AnalyzeArgument, count: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_needs(lines, LINES))

    def eval(self, row: Row, file_name: str, start: int, count: int) -> Iterator[tuple]:
        first = max(start, 0)
        if row["file_name"] == file_name and first < row["line_no"] <= first + min(max(count, 1), MOST_LINES):
            yield row["file_name"], row["line_no"], row["line"]


class Names:
    """SQL table function: list_names(TABLE(files), contains) -> each file_name that holds the text once."""

    @staticmethod
    def analyze(files: AnalyzeArgument, contains: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_needs(files, StructType().add("file_name", "string")), partitionBy=[PartitioningColumn("file_name")], select=[SelectedColumn("file_name")])

    def __init__(self) -> None:
        self.told = False

    def eval(self, row: Row, contains: str) -> Iterator[tuple]:
        if not self.told and row["file_name"] is not None and contains in row["file_name"]:
            self.told = True
            yield (row["file_name"],)


class Search:
    """SQL table function: search_docs(TABLE(docs), query, k) -> doc_id and score, the share of the query's terms that a document holds (R2).

    Each task gives its k best (at most 20, ties to the smaller doc_id); ORDER BY score DESC, doc_id LIMIT k gives those of all.
    """

    @staticmethod
    def analyze(docs: AnalyzeArgument, query: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        _needs(docs, StructType().add("doc_id", "long").add("text", "string"))
        return AnalyzeResult(StructType().add("doc_id", "long").add("score", "double"))

    def __init__(self) -> None:
        self.best: list[tuple[float, int]] = []
        self.asked: tuple[str, list[str]] | None = None
        self.k = 0

    def eval(self, row: Row, query: str, k: int) -> None:
        if self.asked is None or self.asked[0] != query:
            self.asked = query, [t for t in dict.fromkeys(query.lower().split()) if len(t) >= 3]
            self.k = min(max(k, 1), MOST_RESULTS)
        terms = self.asked[1]
        low = (row["text"] or "").lower()
        hits = sum(t in low for t in terms)
        if hits:
            heapq.heappush(self.best, (hits / len(terms), -row["doc_id"]))
            if len(self.best) > self.k:
                heapq.heappop(self.best)

    def terminate(self) -> Iterator[tuple]:
        for score, less in self.best:
            yield -less, score


TABLE_FUNCTIONS = {"grep_lines": Grep, "read_lines": ReadLines, "list_names": Names, "search_docs": Search}


def aggregate(spark: SparkSession, name: str, f: Callable[..., float], returns: str = "double") -> Callable[..., Column]:
    """Register an aggregate of one's own for SQL and return it for DataFrames: ``f`` gets a group's columns as arrays (without
    rows that hold a null). A group is one call, so it must fit a task; aggregates of any size are built-in expressions."""

    def run(*columns: pd.Series) -> float:
        rows = pd.concat(columns, axis=1).dropna()
        return f(*(rows.iloc[:, i].to_numpy() for i in range(rows.shape[1])))

    run.__annotations__ = {"columns": pd.Series, "return": float}
    made = F.pandas_udf(run, returns)
    spark.udf.register(name, made)
    return made


def sign_flip_p(differences: np.ndarray, draws: int = 2000, seed: int = 7) -> float:
    """Share of random sign flips of paired differences whose sum is at least as far from zero, itself counted."""
    d = differences[differences != 0].astype(float)
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (draws, len(d)))
    return float(((np.abs(signs @ d) >= abs(d.sum()) - 1e-9).sum() + 1) / (draws + 1))


def register(spark: SparkSession) -> list[str]:
    """Register the functions, table functions and aggregates of this engine for SQL; their names."""
    scalar = {
        "calculate": (numbers.calculate, "string"), "math_answer": (numbers.math_answer, "string"), "grade_answer": (numbers.grade, "boolean"), "final_answer": (lambda t: numbers.final_answer(t or ""), "string"),
        "judge_status": (lambda t: structured.support_verdict(t)["status"], "string"),
    }
    for name, (f, returns) in scalar.items():
        spark.udf.register(name, F.pandas_udf(_vector(f), returns))
    spark.udtf.register("lines_of", F.udtf(Lines, returnType="line_no int, line string"))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers of table functions may not see the driver's path
    for name, kind in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(kind))
    aggregate(spark, "sign_flip_p", sign_flip_p)
    return [*scalar, "lines_of", *TABLE_FUNCTIONS, "sign_flip_p"]


def _vector(f: Callable) -> Callable:
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*xs) for xs in zip(*columns, strict=True)], dtype=object)

    run.__annotations__ = {"return": pd.Series, "columns": pd.Series}
    return run


def reward(f: Callable[..., Mapping[str, float]], keys: tuple[str, ...]) -> Callable[..., Column]:
    """A custom reward as a column: keyword arguments in, a struct of doubles with the same keys on every path out. What
    it leaves out is 0; an exception scores 0 and sets ``error``."""

    def apply(**columns: Column) -> Column:
        names = list(columns)

        def one(values: tuple) -> dict[str, float]:
            try:
                got = f(**dict(zip(names, values, strict=True)))
                return {k: float(got.get(k, 0.0)) for k in keys} | {"error": 0.0}
            except Exception:
                return dict.fromkeys(keys, 0.0) | {"error": 1.0}

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([one(v) for v in batch.itertuples(index=False, name=None)], columns=[*keys, "error"])

        run.__annotations__ = {"batch": pd.DataFrame, "return": pd.DataFrame}
        return F.pandas_udf(run, ", ".join(f"{k} double" for k in (*keys, "error")))(F.struct(*(c.alias(n) for n, c in columns.items())))

    return apply


def tool(build: Callable[..., DataFrame], known: tuple[str, ...], required: tuple[str, ...]) -> Callable[..., DataFrame]:
    """A retrieval operator as a tool: unknown and missing arguments are refused before anything runs (Q15)."""

    def call(**arguments) -> DataFrame:
        wrong = [f"missing {k}" for k in required if k not in arguments] + [f"unknown {k}" for k in arguments if k not in known]
        if wrong:
            raise ValueError(", ".join(wrong))
        return build(**arguments)

    return call
