"""Scalar functions on tool names, chat turns and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def action_name(turn: Column) -> Column:
    """The name on the first `Action:` line; null if there is none or it is Finish."""
    name = F.trim(F.regexp_extract(turn, r"(?m)^Action:\s*(.+)$", 1))
    return F.when((name != "") & (name != "Finish"), name)


def call_succeeded(result: Column) -> Column:
    """Whether the result is a JSON object whose error is the empty string."""
    return F.coalesce(F.get_json_object(result, "$.error") == "", F.lit(False))


def trajectory_succeeded(turns: Column) -> Column:
    """Whether the last assistant turn with a verdict, of array<string>, gives an answer."""
    verdicts = F.filter(turns, lambda t: t.contains("give_answer") | t.contains("give_up_and_restart"))
    return F.coalesce(F.get(verdicts, F.size(verdicts) - 1).contains("give_answer"), F.lit(False))


def task_text(turn: Column) -> Column:
    """The text without a leading `Step N:`."""
    return F.trim(F.regexp_replace(turn, r"^Step \d+:\s*", ""))


def category(tool: Column, default: Column | None = None) -> Column:
    """What follows the last `_for_`; without one, the default (the name itself if not given)."""
    return F.when(F.instr(tool, "_for_") > 0, F.substring_index(tool, "_for_", -1)).otherwise(tool if default is None else default)


def endpoint(tool: Column) -> Column:
    """What precedes the last `_for_`; without one, the name."""
    return F.coalesce(F.nullif(F.regexp_extract(tool, "^(.*)_for_(.*)$", 1), F.lit("")), tool)


def log_query(text: Column) -> Column:
    """The user's request of an API log: up to TIME: or Generate, else the rest of the line."""
    short = F.trim(F.regexp_extract(text, r"(?s)User:\s*(.*?)\s*(?:TIME:|Generate)", 1))
    rest = F.trim(F.regexp_extract(text, r"User:\s*(.*)", 1))
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(rest, F.lit("")))


def api_name(text: Column) -> Column:
    """The name in `[Name(`; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\[(\w+)\(", 1), F.lit(""))


#: One object with a name and, before it ends, a description.
_DESCRIBED = r'\{\s*"name"\s*:\s*"([^"]+)"[^}]*"description"\s*:\s*"([^"]+)"'


def described_apis(text: Column) -> Column:
    """array<struct<name, description>>: the objects of a JSON-like text that have both, each with its own."""
    objects = F.regexp_extract_all(text, F.lit(_DESCRIBED), 0)
    return F.transform(objects, lambda o: F.struct(F.regexp_extract(o, _DESCRIBED, 1).alias("name"), F.regexp_extract(o, _DESCRIBED, 2).alias("description")))


#: The tokens of a Python literal: strings in either quote, names, numbers, and marks; anything else makes a token of its own.
_TOKEN = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[A-Za-z_]\w*+|[-+.\d][-+.\w]*+|\S"""


def literal_json(literal: Column) -> Column:
    """A Python literal of lists, dicts, strings, numbers, True, False and None as JSON text.

    Strings are found by their own quotes, so apostrophes and quotes inside them stay what they are. Escapes that JSON
    has not are put into its own; a backslash before any other character stands for itself, as it does in Python.
    """

    def string(token: Column) -> Column:
        body = F.substring(token, F.lit(2), F.char_length(token) - 2)
        body = F.regexp_replace(body, r"\\'", "'")
        body = F.regexp_replace(body, r'(?<!\\)((?:\\\\)*)"', '$1\\\\"')
        body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
        body = F.regexp_replace(body, r'(?<!\\)((?:\\\\)*)\\([^"\\/bfnrtu])', r"$1\\\\$2")
        return F.concat(F.lit('"'), body, F.lit('"'))

    def token(t: Column) -> Column:
        words = F.when(t == "True", "true").when(t == "False", "false").when(t == "None", "null").otherwise(t)
        return F.when(t.startswith("'") | t.startswith('"'), string(t)).otherwise(words)

    tokens_ = F.regexp_extract_all(literal, F.lit(_TOKEN), 0)
    last = lambda t, i: (t == ",") & F.coalesce(F.get(tokens_, i + 1).isin("]", "}"), F.lit(False))  # noqa: E731  Python allows a last comma
    return F.array_join(F.transform(F.filter(tokens_, lambda t, i: ~last(t, i)), token), " ")


#: What a description begins with in chat samples, up to its first quote.
_PREAMBLE = r'This is the subfunction for tool "[^"]+", you can use this tool\.The description of this function is: "?'


def tool_list(system: Column, marker: str = "Specifically, you have access to the following APIs:") -> Column:
    """array<struct<name, description>>: the literal list of tools after a fixed sentence, without Finish and without nameless ones.

    A list that is no such literal gives no tools; a tool without a description has an empty one.
    """
    literal = F.regexp_extract(system, f"(?s){marker}\\s*(\\[.+\\])", 1)
    parsed = F.from_json(literal_json(literal), "array<struct<name: string, description: string>>", {"allowUnquotedControlChars": "true"})
    rows = F.filter(F.coalesce(parsed, F.expr("array()")), lambda r: F.coalesce(r["name"], F.lit("")).isin("", "Finish") == F.lit(False))
    plain = lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(d, F.lit("")), _PREAMBLE, ""), r"(?U)^\s+|\s+\z", ""), r'"+\z', "")
    return F.transform(rows, lambda r: F.struct(r["name"].alias("name"), plain(r["description"]).alias("description")))


def collapsed(seq: Column) -> Column:
    """The sequence with each run of equal neighbours once."""
    return F.filter(seq, lambda x, i: (i == 0) | (x != F.get(seq, i - 1)))


def embedding_text(tool: Column, kind: Column, description: Column) -> Column:
    return F.translate(F.concat(tool, F.lit(". Category: "), kind, F.lit(". "), F.coalesce(description, F.lit(""))), "_", " ")


def tokens(text: Column) -> Column:
    """Lower-cased words between white space, in order."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def length_bucket(n: Column, scheme: str = "ranges") -> Column:
    """Three schemes: `short` (<= 3, <= 6, more), `ranges` (1-2, 3-4, 5+), `two` (2, 3+)."""
    if scheme == "short":
        return F.when(n <= 3, "short").when(n <= 6, "medium").otherwise("long")
    if scheme == "two":
        return F.when(n <= 2, "short(2)").otherwise("medium(3+)")
    return F.when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5+")


def ranked_names(text: Column) -> Column:
    """The names of a ranked list in free text, lower-cased, in order, each once (arrows, lines, commas)."""
    parts = F.split(text, "->|→|[\\n,;]")
    plain = F.transform(parts, lambda p: F.lower(F.trim(F.regexp_replace(F.trim(p), "^\\s*(?:\\d+[.)]|[-*])\\s*|[\"'`\\[\\]]", ""))))
    return F.array_distinct(F.filter(plain, lambda p: p != ""))


def zero_shot_prompt(task: Column, tools: Column) -> Column:
    return F.format_string("Task: %s\nTools: %s\nList the tools to call, in order.", task, F.array_join(tools, ", "))


def few_shot_prompt(task: Column, tools: Column, examples: Column) -> Column:
    """examples: array<struct<task, seq: array<string>>>."""
    shown = F.transform(examples, lambda e: F.concat(F.lit("Task: "), e["task"], F.lit("\nAnswer: "), F.array_join(e["seq"], " -> ")))
    return F.concat(F.array_join(shown, "\n\n"), F.lit("\n\n"), zero_shot_prompt(task, tools))


def shown_plan(tools: Column, method: Column, score: Column) -> Column:
    """A plan on one line, with the endpoints of its tools."""
    return F.concat(F.lit("["), method, F.lit("] "), F.array_join(F.transform(tools, endpoint), " -> "), F.format_string(" (%.4f)", score))
