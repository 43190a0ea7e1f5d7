"""Values that must equal the recorded runs' producers for results to match.

Fixed values: everything below is stated as the producing code uses it, in
its natural order; modules import from here rather than restating them.
"""

from __future__ import annotations

# --- job log delimiters (agent job output) ---------------------------------
PREDS_START = "<<PREDS_JSON_START_7829361>>"
PREDS_END = "<<PREDS_JSON_END_7829361>>"
PATCH_START = "<<PATCH_START_7829361>>"
PATCH_END = "<<PATCH_END_7829361>>"
EVAL_START = "<<EVAL_OUTPUT_START_7829361>>"
EVAL_END = "<<EVAL_OUTPUT_END_7829361>>"
TRAJ_START = "<<TRAJ_JSON_START_7829361>>"
TRAJ_END = "<<TRAJ_JSON_END_7829361>>"

# --- patch-apply markers and the apply methods, in the order they are tried -
APPLIED = ">>>>> Applied Patch"
APPLY_FAILED = ">>>>> Patch Apply Failed"
APPLY_METHODS = ("git apply --verbose", "git apply --verbose --reject", "patch --batch --fuzz=5 -p1 -i")

# --- exit-code sentinel appended to every sandbox command ------------------
RC_SENTINEL = r"__RC_8372916__:(\d+)\n?"

# --- math answers: the three patterns, tried in this order -----------------
ANSWER_BOXED = r"\\boxed\{([^}]+)\}"
ANSWER_HASH = r"####\s*(-?[\d,]+\.?\d*)"
ANSWER_NUMBER = r"-?[\d,]+\.?\d*"
ANSWER_TOLERANCE = 1e-6

# --- tool calls -------------------------------------------------------------
TOOL_BASH = r"<bash>(.*?)</bash>"          # dot matches newlines
TOOL_SUBMIT = r"<submit\s*/>"

# --- code fences --------------------------------------------------------------
PY_FENCE = "```python"
FENCE = "```"

# --- multi-turn feedback message ---------------------------------------------
FEEDBACK_HEADER = "Your solution was evaluated. Here is the feedback:\n"
ALL_PASSED = "\nAll checks passed."
PLEASE_REVISE = "\nPlease revise your solution to address the issues above."

# --- prior-attempt history appended to the problem statement -----------------
HISTORY_SEPARATOR = "\n\n---\nPrior attempts and feedback:\n\n"

# --- dataset name -> subset name ------------------------------------------------
DATASET_ALIASES = [
    ("princeton-nlp/SWE-Bench", "full"),
    ("princeton-nlp/SWE-bench", "full"),
    ("princeton-nlp/SWE-Bench_Verified", "verified"),
    ("princeton-nlp/SWE-bench_Verified", "verified"),
    ("princeton-nlp/SWE-Bench_Lite", "lite"),
    ("princeton-nlp/SWE-bench_Lite", "lite"),
    ("SWE-bench/SWE-bench_Lite", "lite"),
    ("SWE-bench/SWE-bench_Verified", "verified"),
    ("SWE-bench/SWE-Bench_Verified", "verified"),
    ("princeton-nlp/SWE-Bench_Multimodal", "multimodal"),
    ("swe-bench/SWE-Bench_Multilingual", "multilingual"),
    ("SWE-bench/SWE-smith", "smith"),
    ("nebius/SWE-rebench", "rebench"),
]

# --- error rows -----------------------------------------------------------------
NO_PROMPT = "No prompt found for instance"

# --- verifiers ------------------------------------------------------------------
DEFAULT_FINAL_VERIFIERS = ("swe_test",)
VERIFIER_TIMEOUTS = {"ast_check": 120.0, "swe_test": 60.0}   # seconds; base default 60
DEFAULT_TIMEOUT = 60.0

# --- syntax check of hunk fragments ----------------------------------------------
WRAPPER = "async def _():\n    if True:\n"
WRAPPER_INDENT = "        "
SNIPPET_BEFORE, SNIPPET_AFTER = 2, 1

# --- unit-test feedback ------------------------------------------------------------
FAILING_STATUSES = ("FAILED", "ERROR")
SHOWN_TESTS = 20
WHOLE_LOG_BELOW = 4000
LOG_TAIL = 3000

# --- agent episodes ------------------------------------------------------------------
MAX_STEPS = 100        # forced submit at this step
MAX_RETRIES = 2        # extra rollout attempts after an infrastructure error
MAX_OUTPUT_CHARS = 8000
