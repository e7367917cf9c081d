"""Names under which scalar functions can be used from SQL text.

They are SQL functions over built-in expressions, so SQL text stays in the JVM. DataFrame code uses the
Column builders, which give the same values.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import constants as K
from .text import ACCENTED, LIGATURES, PLAIN


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bodies() -> dict[str, str]:
    """Signature and body by name."""
    spelled = "coalesce(value, '')"
    for letter, plain in (("æ", "ae"), ("Æ", "AE")):
        spelled = f"replace({spelled}, '{letter}', '{plain}')"
    longer = ", ".join(f"{_quoted(a)}, {_quoted(b)}" for a, b in LIGATURES.items())
    spelled = f"array_join(transform(split({spelled}, ''), c -> coalesce(element_at(map({longer}), c), c)), '')"
    fold = f"lower(regexp_replace(translate({spelled}, {_quoted(ACCENTED)}, {_quoted(PLAIN)}), '[^\\\\x00-\\\\x7F]', ''))"
    stop = ", ".join(map(_quoted, K.STOP_IDENTITY))
    weights = " + ".join(f"CAST(substr(value, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(K.ORGNR_WEIGHTS))
    check = f"pmod(11 - pmod({weights}, 11), 11)"
    return {
        "fold_text(value STRING) RETURNS STRING": fold,
        "fold_tokens(value STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all({fold}, '[a-z0-9]+', 0), w -> length(w) > 1 AND w NOT IN ({stop}))",
        "orgnr_valid(value STRING) RETURNS BOOLEAN": f"coalesce(CASE WHEN value RLIKE '^[0-9]{{9}}$' THEN {check} = CAST(substr(value, 9, 1) AS INT) END, false)",
    }


def register_functions(spark: SparkSession) -> None:
    for signature, body in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
