"""Table functions for SQL users."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Fixed value: comments, environment marks, math delimiters, braces.
TOKEN = re.compile(r"%[^\n]*|\\(?:begin|end)\{[^}]*\}|\\[()\[\]]|[{}]")


@udtf(returnType="token_no int, line int, token string")
class TexTokens:
    """Tokens of one LaTeX page, for lateral joins in SQL.  The native ``tex_tokens`` operator is faster."""

    def eval(self, tex: str):
        number = 0
        for match in TOKEN.finditer(tex or ""):
            if not match.group().startswith("%"):
                yield number, tex.count("\n", 0, match.start()) + 1, match.group()
                number += 1


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("tex_tokens", TexTokens)
