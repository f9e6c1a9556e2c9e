"""Named functions as Column builders: registered with the types of their parameters, called by name, guarded.

A model call is a function like any other: text in, text out. Offline its place is taken by a rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass
class Registry:
    tools: dict[str, tuple[Callable[..., Column], dict[str, str], str]] = field(default_factory=dict)

    def register(self, name: str, function: Callable[..., Column], parameters: dict[str, str], description: str = "") -> None:
        """parameters: name to SQL type, in order."""
        self.tools[name] = function, parameters, description

    def tool(self, **parameters: str):
        """The same as a decorator: the function's name and first line of its text."""

        def put(f):
            self.register(f.__name__, f, parameters, (f.__doc__ or "").strip().split("\n")[0])
            return f

        return put

    def catalogue(self, spark: SparkSession):
        rows = [(n, d, [f"{k} {t}" for k, t in p.items()]) for n, (_, p, d) in sorted(self.tools.items())]
        return spark.createDataFrame(rows, "name string, description string, parameters array<string>")

    def call(self, name: str, **arguments: Column) -> Column:
        """A struct of status, result (text) and error: unknown names and arguments that don't fit give an error."""
        if name not in self.tools:
            return outcome(error=f"unknown tool {name}")
        function, parameters, _ = self.tools[name]
        if missing := [p for p in parameters if p not in arguments]:
            return outcome(error=f"missing {', '.join(missing)}")
        cast = {p: arguments[p].try_cast(t) for p, t in parameters.items()}
        bad = F.lit(False)
        for p in parameters:
            bad = bad | (arguments[p].isNotNull() & cast[p].isNull())
        result = function(**cast).cast("string")
        return F.when(bad, outcome(error="arguments of another type")).otherwise(outcome(result))

    def dispatch(self, name: Column, arguments: dict[str, Column]) -> Column:
        """As call, for a name that differs from row to row."""
        out = outcome(error="unknown tool")
        for n, (_, parameters, _) in sorted(self.tools.items()):
            held = {p: F.try_element_at(arguments, F.lit(p)) for p in parameters} if isinstance(arguments, Column) else {p: arguments[p] for p in parameters if p in arguments}
            out = F.when(name == n, self.call(n, **held)).otherwise(out)
        return out


def outcome(result: Column | None = None, error: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("error" if error else "success").alias("status"), (none if result is None else result).alias("result"), (F.lit(error) if error else none).alias("error"))


def guarded(value: Column, errors: Column, otherwise: Column | None = None) -> Column:
    """The value where a row has no errors, else what stands in for it."""
    return F.when(F.size(errors) == 0, value).otherwise(F.lit(None) if otherwise is None else otherwise)


def reply_parts(reply: Column) -> Column:
    """Content, tokens and tool calls (name, arguments) of a model's reply in JSON; a malformed one has none."""
    schema = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>,usage:struct<total_tokens:int>>"
    r = F.from_json(reply, schema)
    message = F.get(r["choices"], 0)["message"]
    calls = F.transform(F.coalesce(message["tool_calls"], F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")), lambda c: c["function"])
    return F.struct(message["content"].alias("content"), r["usage"]["total_tokens"].alias("tokens"), calls.alias("calls"))


def listed_rows(reply: Column, schema: str) -> Column:
    """Rows of a model's table: the array in its reply, without the text around it; none where it can't be read."""
    return F.coalesce(F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def chosen_ids(reply: Column, known: Column) -> Column:
    """The known ids among the lines of a reply, in its order, each once."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[-*0-9.)\s]+", ""))
    return F.array_distinct(F.filter(lines, lambda x: F.array_contains(known, x)))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, where no vocabulary is at hand."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")
