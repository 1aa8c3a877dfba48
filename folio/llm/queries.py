"""The queries of this subpackage and the SQL that DuckDB checks them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP1_SQL, op1_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .line_dedup import OP7_SQL, op7_line_dedup
from .main_text import OP9_SQL, op9_main_text
from .mixing import OP10_SQL, op10_mixing
from .parity_join import OP3_SQL, op3_jaccard_join
from .pii import op4_pii
from .token_output import op2_token_output
from .tool_calls import OP5_SQL, op5_tool_calls
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_output": op2_token_output,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii": op4_pii,
    "op5_tool_calls": op5_tool_calls,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op5_tool_calls": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op9_main_text": OP9_SQL, "op10_mixing": OP10_SQL}
