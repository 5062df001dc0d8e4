"""Laboratory results: which rows count, and what number they stand for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.functions.text import none_of, same_text, strip_chars, text_in


@dataclass(frozen=True)
class LabRule:
    """Rows (``keep``) and value of one phenotype; both take a column lookup."""

    phenotype: str
    keep: Callable[[Callable[[str], Column]], Column]
    value: Callable[[Callable[[str], Column]], Column]


def parse_result(number: str | Column, text: str | Column, strips: Sequence[str], dtype: str,
                 sentinels: Sequence[str] = ()) -> Column:
    """The number if there is one, else the text without comparison signs and flags.

    ``strips`` are character sets removed from both ends, one after the other.
    Sentinel texts and text that is no number give NULL.
    """
    n = F.col(number) if isinstance(number, str) else number
    t = F.col(text) if isinstance(text, str) else text
    stripped = reduce(strip_chars, strips, t)
    parsed = stripped.try_cast(dtype)
    if sentinels:
        parsed = F.when(~text_in(t, sentinels), parsed)
    return F.when(n.isNotNull(), n.cast(dtype)).otherwise(parsed)


def _excluded(col: Column, values: Sequence[str]) -> Column:
    return ~text_in(col, values)


# Results and units dropped for every test.
RESULT_SENTINELS = ["canc", "comment"]
UNIT_PATTERNS_EXCLUDED = ["%g/24%", "%gm/24%", "%gms/24"]
# Creatinine.
CREATININE_MAX = 7
CREATININE_UNITS_EXCLUDED = ["GM/VOL", "GM/VOLUME", "mL/mn/1.73", "ML/Min", "U/L", "ng/mL", "mg/day", "mmol/L",
                             "g/L"]
# Natriuretic peptides.
BNP_RESULTS_EXCLUDED = ["NONREPORTABLE", "NOT REPORTED"]
BNP_UNIT_PER_DL = "pg/dL"
BNP_UNITS = ["pGm/mL", "ng/mL", "pg/ml"]
PROBNP_UNITS_EXCLUDED = ["ug/L", "mcg/L"]
# Potassium.
POTASSIUM_REF_LOW_EXCLUDED = [
    '""Not Estab.""', '"NOT ESTAB."', '"Not established"', '"SEE INTERPRETATION"', '"Variable"', "12", "19", "25",
    "25.0", "26.0", "27", "30", "35", "NO RANGES EXIST", "NOT ESTAB.", "Variable",
]
POTASSIUM_MAX = 8.5
# Albumin.
ALBUMIN_UNITS = ["g/dL", "mg/dL", "gm/dl", "GMS/DL", "g/L", "gr/dL"]
ALBUMIN_REF_HIGH_EXCLUDED = ["5000", "50", "5410"]


def _bnp_value(c: Callable[[str], Column]) -> Column:
    number, text, units = c("result_number"), c("result_text"), c("units")
    parsed = strip_chars(strip_chars(strip_chars(text, "<"), ">"), " <").try_cast("decimal(8,2)")
    return (F.when(number.isNotNull() & same_text(units, BNP_UNIT_PER_DL), (number / 100).cast("decimal(8,2)"))
            .when(number.isNotNull() & text_in(units, BNP_UNITS), number.cast("decimal(8,2)"))
            .when(number.isNull() & same_text(text, "see comment"), F.lit(None))
            .otherwise(parsed))


def _number(dtype: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda c: c("result_number").cast(dtype)


DEFAULT_LAB_RULES = [
    LabRule("Creatinine",
            lambda c: (c("result_number").isNotNull() & none_of(c("test_name"), ["%URINE%"])
                       & (c("result_number") <= CREATININE_MAX) & c("ref_high").isNotNull()
                       & _excluded(c("units"), CREATININE_UNITS_EXCLUDED)),
            _number("decimal(8,2)")),
    LabRule("BNP", lambda c: _excluded(c("result_text"), BNP_RESULTS_EXCLUDED), _bnp_value),
    LabRule("NT-proBNP",
            lambda c: (c("result_text") != "") & _excluded(c("units"), PROBNP_UNITS_EXCLUDED),
            lambda c: parse_result(c("result_number"), c("result_text"), ["<", ">", "Hh", " "], "decimal(14,2)")),
    LabRule("potassium",
            lambda c: (_excluded(c("ref_low"), POTASSIUM_REF_LOW_EXCLUDED)
                       & none_of(c("units"), ["%/24h"])
                       & (c("ref_low").isNotNull() | (c("result_number") <= POTASSIUM_MAX))),
            _number("decimal(14,2)")),
    LabRule("Albumin",
            lambda c: (text_in(c("units"), ALBUMIN_UNITS) & c("ref_high").isNotNull()
                       & _excluded(c("ref_high"), ALBUMIN_REF_HIGH_EXCLUDED)),
            _number("decimal(14,2)")),
    LabRule("Hemoglobin", lambda c: none_of(c("test_name"), ["%SERUM%", "%PLASMA%"]),
            _number("decimal(14,2)")),
]


def admissible_labs(labs: DataFrame, end: str, specimen_ts: str = "specimen_ts") -> DataFrame:
    """Rows with a specimen time up to the study end, a usable result and no 24-hour unit."""
    return labs.where(
        F.col(specimen_ts).isNotNull() & (F.col(specimen_ts) <= F.lit(end).cast("timestamp_ntz"))
        & F.col("result_text").isNotNull() & _excluded(F.col("result_text"), RESULT_SENTINELS)
        & none_of("units", UNIT_PATTERNS_EXCLUDED))


def clean_labs(labs: DataFrame, rules: Sequence[LabRule] = tuple(DEFAULT_LAB_RULES), phenotype: str = "phenotype",
               value: str = "value", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows kept by the rule of their phenotype, with the parsed value; duplicates fall away.

    Phenotypes exclude each other, so one pass with a CASE per rule replaces one
    branch per phenotype.
    """
    kept, number = F.lit(False), F.lit(None).cast("decimal(14,2)")
    for rule in rules:
        mine = same_text(phenotype, rule.phenotype)
        kept = kept | (mine & F.coalesce(rule.keep(F.col), F.lit(False)))
        number = F.when(mine, rule.value(F.col).cast("decimal(14,2)")).otherwise(number)
    out = labs.where(kept).withColumn(value, number)
    return (out if keep is None else out.select(*keep, value)).distinct()
