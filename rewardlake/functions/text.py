"""Python-exact text helpers as Column expressions.

Spark's ``trim`` removes spaces only and ``split`` knows one separator; the
recorded runs were produced by Python code whose ``strip()`` and
``splitlines()`` use wider character sets.  These helpers reproduce them
with JVM regex functions (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (ANSWER_BOXED, ANSWER_HASH, ANSWER_NUMBER, ANSWER_TOLERANCE, APPLIED,  # noqa: F401
                         APPLY_FAILED, EVAL_END, EVAL_START, FENCE, MAX_OUTPUT_CHARS, PATCH_END,
                         PATCH_START, PREDS_END, PREDS_START, PY_FENCE, RC_SENTINEL, TOOL_BASH, TOOL_SUBMIT,
                         TRAJ_END, TRAJ_START)

# Python's definitions: the characters str.isspace() accepts, and the line
# boundaries of str.splitlines(), written as regex classes.
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PY_LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# the same two sets as plain characters (for btrim and negated classes)
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
LINE_BREAK_CLASS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
NOT_LINE_BREAK = r"[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """Python truthiness of an optional string: not null and not ''."""
    c = col_(c)
    return F.coalesce(c != F.lit(""), F.lit(False))


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Python whitespace
    (``btrim`` with the whitespace set: no regex, stays in codegen)."""
    return F.btrim(col_(c), F.lit(PY_SPACE_CHARS))






LINE_BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def split_lines(c) -> Column:
    """``str.splitlines()``: split on every Python line boundary; a trailing
    boundary does not produce a final empty line; '' gives [].

    The trailing boundary is cut with plain string functions so the regex
    split runs once per row."""
    c = col_(c)
    n = F.length(c)
    last = F.right(c, F.lit(1))
    body = (F.when(F.endswith(c, F.lit("\r\n")), F.left(c, n - 2))
            .when(F.instr(F.lit(LINE_BREAK_CHARS), last) > 0, F.left(c, n - 1))
            .otherwise(c))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, PY_LINE_BREAK, -1))




def last_match(c, pattern: str, group: int = 0) -> Column:
    """Last regex match (or group) in ``c``; null when there is none.

    ``element_at(arr, -1)`` raises on an empty array under ANSI mode, so the
    ``try_`` form is used."""
    return F.try_element_at(F.regexp_extract_all(col_(c), F.lit(pattern), F.lit(group)), F.lit(-1))


def between_markers(c, start: str, end: str) -> Column:
    """Text between the first ``start`` and the first ``end`` marker,
    whitespace-stripped; ``''`` if either marker is missing or ``end``
    comes before ``start``."""
    c = col_(c)
    s = F.instr(c, start)
    e = F.instr(c, end)
    body_from = s + F.lit(len(start))
    inner = c.substr(body_from, F.greatest(e - body_from, F.lit(0)))
    return F.when((s > 0) & (e > 0) & (e >= body_from), py_strip(inner)).otherwise(F.lit(""))


def substr_from(c, pos: Column) -> Column:
    """Characters of ``c`` from 1-based ``pos`` to the end."""
    c = col_(c)
    return c.substr(pos, F.greatest(F.length(c) - pos + 1, F.lit(0)))


# ---------------------------------------------------------------- G1-G4
# the answer patterns (constants.ANSWER_*), with Python's whitespace class for \s
BOXED = ANSWER_BOXED
HASH_ANSWER = ANSWER_HASH.replace(r"\s", PY_SPACE)
LAST_NUMBER = ANSWER_NUMBER
# what Python float() accepts once commas and whitespace are gone (ASCII
# digits only, no underscores: SURVEY Q17)
FLOAT_TEXT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def extract_answer(c) -> Column:
    """G1: last ``\\boxed{...}`` (stripped), else the last ``#### n``, else the
    last number-like token (commas removed in the last two); null if none."""
    c = col_(c)
    boxed = py_strip(last_match(c, BOXED, 1))
    hashed = py_strip(F.replace(last_match(c, HASH_ANSWER, 1), F.lit(","), F.lit("")))
    number = py_strip(F.replace(last_match(c, LAST_NUMBER, 0), F.lit(","), F.lit("")))
    return F.coalesce(boxed, hashed, number)


def normalize_number(c) -> Column:
    """Strip commas and whitespace, parse as float; null if unparsable."""
    s = py_strip(F.replace(col_(c), F.lit(","), F.lit("")))
    return F.when(s.rlike(FLOAT_TEXT), s.try_cast("double"))


def strip_prompt(query: Column, prompt: Column) -> Column:
    """The response is the query without the prompt prefix, if present."""
    return F.when(prompt.isNotNull() & F.startswith(query, prompt),
                  substr_from(query, F.length(prompt) + 1)).otherwise(query)


def answer_reward(response: Column, label: Column) -> Column:
    """1.0 iff prediction and gold both parse and differ by < 1e-6.
    Gold falls back to parsing the raw label when extraction gives nothing.
    NaN never matches."""
    pred = normalize_number(extract_answer(response))
    gold_text = F.when(truthy(label), extract_answer(label))
    gold = F.when(truthy(gold_text), normalize_number(gold_text)).otherwise(normalize_number(label))
    ok = F.abs(pred - gold) < F.lit(ANSWER_TOLERANCE)
    return F.when(pred.isNotNull() & gold.isNotNull() & ~F.isnan(pred) & ~F.isnan(gold)
                  & F.coalesce(ok, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- G5


def code_fence(c) -> Column:
    """G5 (SURVEY Q2 decision): the text between the first ```python fence
    and the next closing fence after it; no fence -> the whole text;
    unclosed -> everything after the opener."""
    c = col_(c)
    start = F.instr(c, PY_FENCE)
    body = start + F.lit(len(PY_FENCE))
    rel = F.instr(substr_from(c, body), FENCE)
    return (F.when(start == 0, c)
            .when(rel == 0, substr_from(c, body))
            .otherwise(c.substr(body, rel - 1)))


# ---------------------------------------------------------------- G11-G13

PREDS_SCHEMA = "map<string, struct<instance_id: string, model_patch: string, model_name_or_path: string>>"


def log_patch(logs) -> Column:
    """Raw patch block."""
    return between_markers(logs, PATCH_START, PATCH_END)


def log_eval_output(logs) -> Column:
    return between_markers(logs, EVAL_START, EVAL_END)


def log_trajectory(logs) -> Column:
    return between_markers(logs, TRAJ_START, TRAJ_END)


def log_predictions(logs, instance_id: Column, model_name: Column) -> Column:
    """Prediction struct from the preds JSON block of a log."""
    return block_predictions(between_markers(logs, PREDS_START, PREDS_END), instance_id, model_name)


def block_predictions(block: Column, instance_id: Column, model_name: Column) -> Column:
    """Prediction struct from a preds JSON block: the record under the
    instance's own id (which must carry ``instance_id``), else the only
    record, else an empty prediction; bad JSON -> empty prediction."""
    preds = F.from_json(block, PREDS_SCHEMA)
    own = F.element_at(preds, instance_id)
    has_own = F.coalesce(F.map_contains_key(preds, instance_id), F.lit(False))
    only = F.element_at(F.map_values(preds), 1)
    single = F.coalesce(F.size(preds) == 1, F.lit(False))
    own_ok = has_own & own["instance_id"].isNotNull()
    empty = F.struct(instance_id.alias("instance_id"), F.lit("").alias("model_patch"),
                     model_name.alias("model_name_or_path"))
    return (F.when(has_own,
                   F.when(own_ok, F.struct(own["instance_id"].alias("instance_id"),
                                           F.coalesce(own["model_patch"], F.lit("")).alias("model_patch"),
                                           F.coalesce(own["model_name_or_path"], model_name)
                                           .alias("model_name_or_path"))).otherwise(empty))
            .when(single, F.struct(F.coalesce(only["instance_id"], instance_id).alias("instance_id"),
                                   F.coalesce(only["model_patch"], F.lit("")).alias("model_patch"),
                                   F.coalesce(only["model_name_or_path"], model_name)
                                   .alias("model_name_or_path")))
            .otherwise(empty))


def log_prediction(logs, instance_id: Column, model_name: Column, extraction: Column) -> Column:
    """``preds_json:`` strategies read the JSON block, others the raw
    patch block."""
    raw = F.struct(instance_id.alias("instance_id"), log_patch(logs).alias("model_patch"),
                   model_name.alias("model_name_or_path"))
    return F.when(F.startswith(extraction, F.lit("preds_json:")),
                  log_predictions(logs, instance_id, model_name)).otherwise(raw)


#: the blocks of a job log and their markers
LOG_BLOCKS = {"preds": (PREDS_START, PREDS_END), "patch": (PATCH_START, PATCH_END),
              "eval": (EVAL_START, EVAL_END), "traj": (TRAJ_START, TRAJ_END)}


def log_marks(logs) -> Column:
    """Where every marker of a log first stands (0: nowhere), as one struct
    ``<block>_start, <block>_end, applied, failed``; extractions slice by it."""
    c = col_(logs)
    at = {f"{b}_{side}": m for b, pair in LOG_BLOCKS.items() for side, m in zip(("start", "end"), pair, strict=True)}
    return F.struct(*[F.instr(c, m).alias(n) for n, m in (at | {"applied": APPLIED, "failed": APPLY_FAILED}).items()])


def marked_block(logs, marks: Column, block: str) -> Column:
    """G11 from ``log_marks``: as ``between_markers`` of the block's markers."""
    s, e = marks[f"{block}_start"], marks[f"{block}_end"]
    body = s + F.lit(len(LOG_BLOCKS[block][0]))
    return F.when((s > 0) & (e >= body), py_strip(col_(logs).substr(body, e - body))).otherwise(F.lit(""))


def marked_status(marks: Column) -> Column:
    """G30 from ``log_marks``."""
    return F.when(marks["failed"] > 0, F.lit("failed")).when(marks["applied"] > 0, F.lit("applied")).otherwise(F.lit("unknown"))


def apply_status(logs) -> Column:
    """Patch-apply marker in the job log."""
    logs = col_(logs)
    return (F.when(F.contains(logs, F.lit(APPLY_FAILED)), F.lit("failed"))
            .when(F.contains(logs, F.lit(APPLIED)), F.lit("applied"))
            .otherwise(F.lit("unknown")))


# ---------------------------------------------------------------- G14-G17
BASH_CALL = "(?s)" + TOOL_BASH
SUBMIT_CALL = TOOL_SUBMIT.replace(r"\s", PY_SPACE)


def tool_call(text) -> Column:
    """struct(type, content): leftmost of ``<bash>..</bash>`` and
    ``<submit/>``; neither -> the whole stripped text as bash; blank ->
    submit."""
    t = col_(text)
    bash_full = F.regexp_extract(t, BASH_CALL, 0)
    bash_at = F.when(bash_full != "", F.instr(t, bash_full)).otherwise(F.lit(0))
    sub_full = F.regexp_extract(t, SUBMIT_CALL, 0)
    sub_at = F.when(sub_full != "", F.instr(t, sub_full)).otherwise(F.lit(0))
    bash_body = py_strip(F.regexp_extract(t, BASH_CALL, 1))
    stripped = py_strip(t)
    kind = (F.when((bash_at > 0) & (sub_at > 0),
                   F.when(bash_at < sub_at, F.lit("bash")).otherwise(F.lit("submit")))
            .when(sub_at > 0, F.lit("submit"))
            .when(bash_at > 0, F.lit("bash"))
            .when(stripped != "", F.lit("bash"))
            .otherwise(F.lit("submit")))
    content = (F.when(kind == "submit", F.lit(""))
               .when(bash_at > 0, bash_body)
               .otherwise(stripped))
    return F.struct(kind.alias("type"), content.alias("content"))


def truncate_middle(c, limit: int = MAX_OUTPUT_CHARS) -> Column:
    """Texts longer than ``limit`` keep the first and last ``limit//2``
    characters around a dropped-count marker (``limit >= 2``, SURVEY Q18)."""
    if limit < 2:
        raise ValueError("limit must be >= 2")
    c = col_(c)
    half = limit // 2
    n = F.length(c)
    marker = F.concat(F.lit("\n... ("), (n - F.lit(limit)).cast("string"), F.lit(" chars truncated) ...\n"))
    return F.when(n <= limit, c).otherwise(F.concat(F.left(c, F.lit(half)), marker, F.right(c, F.lit(half))))


def tool_output(stdout, exit_code, limit: int = MAX_OUTPUT_CHARS) -> Column:
    """Truncated output plus an exit-code line when it is non-zero."""
    code = col_(exit_code)
    return F.concat_ws("\n", truncate_middle(stdout, limit),
                       F.when(code != 0, F.concat(F.lit("[exit code: "), code.cast("string"), F.lit("]"))))




def exit_code_split(raw) -> Column:
    """struct(output, exit_code): the first sentinel is cut out wherever
    it is and the rest stripped; no sentinel -> text untouched, -1."""
    raw = col_(raw)
    full = F.regexp_extract(raw, RC_SENTINEL, 0)
    found = full != ""
    at = F.instr(raw, full)
    spliced = F.concat(F.left(raw, at - 1), substr_from(raw, at + F.length(full)))
    return F.struct(
        F.when(found, py_strip(spliced)).otherwise(raw).alias("output"),
        F.when(found, F.regexp_extract(raw, RC_SENTINEL, 1).try_cast("bigint"))
        .otherwise(F.lit(-1).cast("bigint")).alias("exit_code"))


# ---------------------------------------------------------------- G22-G29
def render_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace literal ``{key}`` placeholders one key after another (a
    value inserted earlier can be rewritten by a later key); unknown
    placeholders stay."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value.cast("string"))
    return out


# The wording of our agent's task prompt (not taken from elsewhere).
TASK_PROMPT = (
    "You are fixing a reported problem in a Python code base checked out at /testbed.\n"
    "Use <bash>command</bash> to run a shell command and read its output, and\n"
    "<submit/> when your change is complete. Keep the change small and focused.\n"
    "\nProblem report:\n"
)


def task_prompt(problem: Column) -> Column:
    """Fixed instruction text followed by the problem statement."""
    return F.concat(F.lit(TASK_PROMPT), problem)


def initial_messages(prompt) -> Column:
    """First line is the system message, the rest the user message; a
    single-line prompt is one user message."""
    p = col_(prompt)
    parts = F.split(p, "\n", 2)
    two = F.size(parts) == 2
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.when(two, F.array(msg("system", parts[0]), msg("user", parts[1]))).otherwise(
        F.array(msg("user", p)))


def run_key(instance_id: Column, run_id: Column, prefix: str = "swe") -> Column:
    """Cluster-safe job name: lower-case, ``__`` and ``_`` -> ``-``,
    cut so the whole name fits 63 characters, ``-`` stripped, plus 6 hex
    digits of md5(id-run) (no clock, so it is deterministic)."""
    safe = F.replace(F.replace(F.lower(instance_id), F.lit("__"), F.lit("-")), F.lit("_"), F.lit("-"))
    uid = F.left(F.md5(F.concat(instance_id, F.lit("-"), run_id)), F.lit(6))
    max_base = 63 - len(f"{prefix}--") - 6
    safe = F.regexp_replace(F.left(safe, F.lit(max_base)), r"^-+|-+$", "")
    return F.concat(F.lit(prefix + "-"), safe, F.lit("-"), uid)


def image_dest(image, registry: str, strict: bool) -> Column:
    """Drop the namespace (text through the first ``/``), retag
    ``:latest`` as ``:v1`` and prefix the registry.  Other tags: kept as is
    (``strict=False``, the worker) or rejected -> null (the mirror job)."""
    image = col_(image)
    name = F.when(F.instr(image, "/") > 0, substr_from(image, F.instr(image, "/") + 1)).otherwise(image)
    latest = F.endswith(name, F.lit(":latest"))
    retag = F.concat(F.left(name, F.length(name) - 7), F.lit(":v1"))
    dest = F.when(latest, retag).otherwise(F.lit(None) if strict else name)
    return F.concat(F.lit(registry + "/"), dest)


def repo_key(image) -> Column:
    """Tag stripped (text before the last ``:``), namespace dropped, and
    the part after the known ``sweb.eval.x86_64.`` prefix when present."""
    image = col_(image)
    after_ns = F.when(F.instr(image, "/") > 0, substr_from(image, F.instr(image, "/") + 1)).otherwise(image)
    no_tag = F.regexp_replace(after_ns, r":[^:]*$", "")
    prefix = "sweb.eval.x86_64."
    at = F.instr(no_tag, prefix)
    return F.when(at > 0, substr_from(no_tag, at + F.lit(len(prefix)))).otherwise(no_tag)


def model_slug(name) -> Column:
    """Second ``/`` part (else the first), lower-cased, ``.`` -> ``-``."""
    parts = F.split(col_(name), "/", -1)
    pick = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))
    return F.replace(F.lower(pick), F.lit("."), F.lit("-"))


def s3_parts(uri) -> Column:
    """struct(bucket, key, parent) of an ``s3://`` URI; any other scheme
    fails the job."""
    uri = col_(uri)
    is_s3 = F.startswith(uri, F.lit("s3://"))
    bucket = F.regexp_extract(uri, r"^s3://([^/?#]*)", 1)
    path = F.regexp_extract(uri, r"^s3://[^/?#]*([^?#]*)", 1)
    key = F.regexp_replace(path, r"^/+", "")
    parent = F.regexp_replace(uri, r"/[^/]*$", "")
    checked = F.when(is_s3, bucket).otherwise(
        F.raise_error(F.concat(F.lit("Expected s3:// URI, got: "), uri)).cast("string"))
    return F.struct(checked.alias("bucket"), key.alias("key"), parent.alias("parent"))


def redact_api_key(cmd) -> Column:
    """Mask the value after ``--model-api-key`` in a logged command."""
    return F.regexp_replace(col_(cmd), r"(--model-api-key )[^ ]+", "$1***REDACTED***")


# ---------------------------------------------------------------- G32-G33
def check_program(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    """Prompt + completion + newline + test + newline + check(entry)."""
    return F.concat(prompt, completion, F.lit("\n"), test, F.lit("\n"),
                    F.lit("check("), entry_point, F.lit(")"))


def outcome_label(result) -> Column:
    """G33: 'passed' / 'timed out' / 'failed' from a recorded outcome text; an
    empty outcome means the run timed out."""
    r = col_(result)
    return (F.when(~truthy(r), F.lit("timed out"))
            .when(r == "passed", F.lit("passed"))
            .when(r == "timed out", F.lit("timed out"))
            .otherwise(F.lit("failed")))


def snippet(text, lineno: Column, before: int = 2, after: int = 1) -> Column:
    """Lines around ``lineno`` (1-based) with an arrow on that line and a
    4-wide line number; null if ``lineno`` is null or out of range."""
    lines = split_lines(text)
    n = F.size(lines)
    start = F.greatest(lineno - before, F.lit(1))
    end = F.least(n, lineno + after)
    window = F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))

    def fmt(line, i):
        no = start + i
        marker = F.when(no == lineno, F.lit("-->")).otherwise(F.lit("   "))
        num = no.cast("string")
        num = F.when(F.length(num) < 4, F.lpad(num, 4, " ")).otherwise(num)
        return F.concat(F.lit("    "), marker, F.lit(" "), num, F.lit("   "), line)

    return F.when(lineno.isNotNull() & (lineno >= 1) & (lineno <= n),
                  F.array_join(F.transform(window, fmt), "\n"))
