"""Verdicts over agent transcripts: file access, prompts, and tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.constants import BLOCKING_SEVERITY, FILE_TOOLS, OUTPUT_TOOLS
from wardlake.functions.expressions import let
from wardlake.functions.json_leaves import redact_json_column
from wardlake.functions.masking import session_pads
from wardlake.functions.paths import is_sensitive_path
from wardlake.functions.pii import detect_spans, severity_of
from wardlake.functions.secrets import detect_secrets


def file_access_reason(path: Column, resolution: Column) -> Column:
    """Why a file tool is denied; NULL when it is not.

    `resolution` tells what resolving the path on the agent's machine found. A path
    that could not be resolved is denied, since a link may hide a sensitive target.
    """
    sensitive = F.concat(
        F.lit("Access to `"), path,
        F.lit("` is blocked: the path is known to hold credentials or key material."),
    )
    unresolved = F.concat(
        F.lit("Access to `"), path,
        F.lit("` is blocked: the path could not be resolved, so it cannot be checked for links."),
    )
    return (
        F.when(is_sensitive_path(path) | (resolution == "sensitive"), sensitive)
        .when(resolution == "unresolved", unresolved)
    )


def prompt_block_reason(prompt: Column) -> Column:
    """Why a prompt is blocked, naming labels only; NULL when it is not."""

    def build(found: Column) -> Column:
        serious = F.filter(found["pii"], lambda s: severity_of(s["label"]) >= BLOCKING_SEVERITY)
        labels = lambda items: F.array_sort(F.array_distinct(F.transform(items, lambda x: x["label"])))
        return let(
            F.concat(labels(found["secrets"]), labels(serious)),
            lambda names: F.when(
                F.size(names) > 0,
                F.concat(
                    F.lit("The prompt holds a secret or sensitive identifier ("),
                    F.array_join(names, ", "),
                    F.lit("). Remove it and submit again."),
                ),
            ),
        )

    found = F.struct(detect_secrets(prompt).alias("secrets"), detect_spans(prompt).alias("pii"))
    return F.when(prompt.isNotNull(), let(found, build))


def requested_path() -> Column:
    """The file a tool asks for."""
    return F.coalesce(F.col("tool_input.file_path"), F.col("tool_input.notebook_path"))


def redact_tool_output(transcripts: DataFrame, pads: Column) -> DataFrame:
    """Mask string leaves of `tool_response`; adds `updated_output` and `mapping`.

    Both are NULL where nothing changed. Only rows of output tools reach the Arrow
    functions with a value.
    """
    eligible = (F.col("hook_event_name") == "PostToolUse") & F.col("tool_name").isin(OUTPUT_TOOLS)
    staged = transcripts.withColumn("_raw", F.when(eligible, F.col("tool_response")))
    masked = redact_json_column(staged, "_raw", pads).drop("_raw")
    return masked.withColumnsRenamed({"redacted_json": "updated_output", "json_mapping": "mapping"})


def session_context(flag: str | None = None, environment: str | None = None) -> Column:
    """Context of a session's salt: a flag, an environment value, the session id, or empty."""
    for fixed in (flag, environment):
        if fixed is not None:
            return F.lit(fixed)
    return F.coalesce(F.col("session_id"), F.lit(""))


def hook_verdicts(
    transcripts: DataFrame,
    machine_pads: Column,
    flag: str | None = None,
    environment: str | None = None,
) -> DataFrame:
    """A verdict for every transcript row.

    Adds `action` (`deny`, `block`, `redact`, or NULL for no effect), `reason`,
    `updated_output` and `mapping`. Unknown events and tools have no effect. Each
    session masks under its own salt, derived per row, so nothing is joined.
    """
    path = requested_path()
    file_tool = (F.col("hook_event_name") == "PreToolUse") & F.col("tool_name").isin(FILE_TOOLS)
    is_prompt = F.col("hook_event_name") == "UserPromptSubmit"
    salted = transcripts.withColumn("_pads", session_pads(session_context(flag, environment), machine_pads))
    masked = redact_tool_output(salted, F.col("_pads")).drop("_pads")
    judged = masked.withColumns(
        {
            "_denied": F.when(file_tool, file_access_reason(path, F.col("resolution"))),
            "_blocked": F.when(is_prompt, prompt_block_reason(F.col("prompt"))),
        }
    )
    action = (
        F.when(F.col("_denied").isNotNull(), "deny")
        .when(F.col("_blocked").isNotNull(), "block")
        .when(F.col("updated_output").isNotNull(), "redact")
    )
    return judged.withColumns(
        {"action": action, "reason": F.coalesce("_denied", "_blocked")}
    ).drop("_denied", "_blocked")
