"""A table function that turns a text into rows of facts by named patterns; schema and patterns are arguments.

    SELECT d.doc_id, f.* FROM documents d, LATERAL extract_facts(d.text, 'value double, unit string', map('rate', '(?P<value>[0-9]+)(?P<unit>%)')) f

A row for each match of each pattern: type (the pattern's name), pos (from 0 on in the text, over its sentences), and a column for each field of the schema,
filled from the group of the same name and cast to its type; a group that is absent, unmatched or no number is null. Numbers may
have thousands separators. Patterns are regular expressions of Python's ``regex``. A null text gives no rows. Rows travel in Arrow batches.
"""

from __future__ import annotations

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

CUT = regex.compile(r"[。．；;\n]|(?<![0-9])\.(?![0-9])")


#: Types of fields by name.
KINDS: dict[str, DataType] = {"string": StringType(), "long": LongType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def _fields(told: str) -> list[tuple[str, DataType]]:
    """(name, type) of each field of 'name type, name type'."""
    parts = [f.split() for f in told.split(",")]
    if any(len(p) != 2 or p[1].lower() not in KINDS or p[0] in ("type", "pos") for p in parts):
        raise ValueError(f"no schema of facts: {told!r}; fields are a name and one of {', '.join(KINDS)}")
    return [(name, KINDS[kind.lower()]) for name, kind in parts]


def _cast(value: str | None, kind: DataType):
    """A matched group as its field's type; null where it does not parse."""
    if value is None or isinstance(kind, StringType):
        return value
    try:
        if isinstance(kind, BooleanType):
            return value != ""
        number = float(value.replace(",", ""))
        return int(number) if isinstance(kind, LongType) else number
    except ValueError:
        return None


class ExtractFacts:
    """Handler of the table function."""

    @staticmethod
    def analyze(text: AnalyzeArgument, fields: AnalyzeArgument, patterns: AnalyzeArgument) -> AnalyzeResult:
        if not fields.isConstantExpression or not isinstance(fields.value, str):
            raise ValueError("the schema of facts is a constant text, such as 'value double, unit string'")
        schema = StructType().add("type", StringType()).add("pos", LongType())
        for name, kind in _fields(fields.value):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema)

    def __init__(self):
        self.asked: tuple[str, list[tuple[str, DataType]]] = ("", [])
        self.forms: dict[str, regex.Pattern] = {}

    def eval(self, text: str | None, fields: str, patterns: dict[str, str]):
        if text is None:
            return
        if self.asked[0] != fields:
            self.asked = fields, _fields(fields)
        for pos, sentence in enumerate(s for s in (p.strip(" ") for p in CUT.split(text)) if s):
            for name, pattern in patterns.items():
                form = self.forms.get(pattern) or self.forms.setdefault(pattern, regex.compile(pattern))
                for m in form.finditer(sentence):
                    groups = m.groupdict()
                    yield (name, pos, *[_cast(groups.get(f), kind) for f, kind in self.asked[1]])


def register(spark: SparkSession, name: str = "extract_facts") -> None:
    """Makes the table function known to SQL under a name."""
    spark.udtf.register(name, udtf(ExtractFacts, useArrow=True))
