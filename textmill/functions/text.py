"""Text functions: years, answers, programs, punctuation, pre-tokens, samples and prompts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_year(date: Column, first: int = 1000, last: int = 2100) -> Column:
    """The first run of four digits, if it is a year in [first, last]; later runs are not looked at."""
    year = F.regexp_extract(date, "[0-9][0-9][0-9][0-9]", 0).try_cast("int")
    return F.when(year.between(first, last), year)


def final_number(completion: Column) -> Column:
    """What follows the first "#### ", without commas; null if there is none."""
    found = F.regexp_extract(completion, r"#### (-?[0-9.,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))


def program(completion: Column) -> Column:
    """The first fenced code block, else the whole text; trimmed."""
    fenced = F.regexp_extract(completion, r"(?s)```(?:python)?\s*\n(.*?)\n```", 1)
    has = F.regexp_like(completion, F.lit(r"(?s)```(?:python)?\s*\n.*?\n```"))
    return F.regexp_replace(F.when(has, fenced).otherwise(completion), r"(?U)^\s+|\s+$", "")


def leading_imports(prompt: Column) -> Column:
    """Import lines at the start, up to the first line that is neither import, comment nor blank."""
    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        is_import = bare.startswith("import ") | bare.startswith("from ")
        other = (bare != "") & ~bare.startswith("#") & ~is_import
        over = state["over"] | other
        return F.struct(over.alias("over"), F.when(~over & is_import, F.concat(state["kept"], F.array(bare))).otherwise(state["kept"]).alias("kept"))

    return F.array_join(F.aggregate(F.split(prompt, "\n"), start, step, lambda s: s["kept"]), "\n")


def tool_parts(answer: Column) -> Column:
    """Parts of an answer with <<expression=result>> calls: array of (type, text); the result follows the last "="."""
    pieces = F.split(answer, r"(?=<<[^>]+>>)|(?<=>>)")

    def part(p: Column) -> Column:
        call = F.regexp_extract(p, r"^<<([^>]+)>>$", 1)
        item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
        split = F.regexp_like(call, F.lit("="))
        return F.when(call == "", F.array(item("text", p))).otherwise(F.array(item("python", F.when(split, F.regexp_extract(call, r"(?s)^(.*)=[^=]*$", 1)).otherwise(call)), item("python_output", F.when(split, F.regexp_extract(call, r"=([^=]*)$", 1)).otherwise(F.lit("")))))

    return F.flatten(F.transform(pieces, part))


#: Marks that end a turn or leave it open on purpose; characters that may close one behind them.
END_MARKS = ".!?…:;,-–—"
CLOSERS = "\"'`’”)]}»"
#: Fixed value: what a clean reply ends in.
REPLY_ENDS = ".?!…\"'"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def needs_terminal_mark(text: Column) -> Column:
    """Whether a text ends without an end mark; never inside an open code fence."""
    bare = _bare(text)
    fences = (F.length(bare) - F.length(F.replace(bare, F.lit("```"), F.lit("")))) / 3
    core = F.rtrim(bare, F.lit(CLOSERS))
    return (bare != "") & (fences % 2 == 0) & (core != "") & ~F.substring(core, -1, 1).isin(*END_MARKS)


def add_terminal_mark(text: Column) -> Column:
    """The text with a period behind its last visible character, where it needs one."""
    bare = _bare(text)
    return F.when(needs_terminal_mark(text), F.concat(bare, F.lit("."), F.substr(text, F.length(bare) + 1))).otherwise(text)


def multiple_choice(question: Column, letters: Column, choices: Column) -> Column:
    lines = F.zip_with(choices, letters, lambda c, x: F.concat(F.lit("- "), c, F.lit("="), x, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("\nRespond only with the letter of the correct answer."))


#: Fixed value: the pre-token pattern (groups of one or two digits), with Unicode classes as in the regex module.
PRE_TOKEN = r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def sample_head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def sample_window(text: Column, n: int, pick: Column) -> Column:
    """n characters from a start in [0, length - n] given by pick, a non-negative integer."""
    start = F.when(F.length(text) > n, F.pmod(pick, F.length(text) - n + 1)).otherwise(0)
    return F.substr(text, (start + 1).cast("int"), F.lit(n))


def sample_chunks(text: Column, n: int, k: int = 3) -> Column:
    """k evenly spaced chunks of max(1, n div k) characters; texts of at most n characters whole."""
    size = max(1, n // k)
    span = F.length(text) - size
    chunks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substr(text, F.bround(i * span / max(1, k - 1)).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= n, text).otherwise(F.array_join(chunks, ""))


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share at their start."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.get(b, i) == x)
    return F.when(n <= 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def pad_right(a: Column, n: Column | int, value: int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def reply_verdict(text: Column, most_tokens: int) -> Column:
    """EMPTY, RAN ON (longer than 3.5 characters a token, and no end), NO STOP (no end) or clean."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    ends = F.substring(bare, -1, 1).isin(*REPLY_ENDS)
    return F.when(bare == "", "EMPTY").when(ends, "clean").when(F.length(bare) > 3.5 * most_tokens, "RAN ON").otherwise("NO STOP")


def letter_count(word: Column, letter: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, letter, F.lit("")))


def spelled(word: Column) -> Column:
    return F.array_join(F.split(word, ""), ",")


def _with_shots(shots: Column, prompt: Column) -> Column:
    return F.array_join(F.concat(shots, F.array(prompt)), "\n\n")


def choice_prompts(question: Column, choices: Column, shots: Column, delimiter: str) -> Column:
    """A prompt for each choice: example blocks, then question, delimiter and choice."""
    return F.transform(choices, lambda c: _with_shots(shots, F.concat(question, F.lit(delimiter), c)))


def schema_prompts(contexts: Column, continuation: Column, shots: Column, delimiter: str) -> Column:
    """A prompt for each context, with the same continuation."""
    return F.transform(contexts, lambda c: _with_shots(shots, F.concat(c, F.lit(delimiter), continuation)))


def continuation_prompts(context: Column, continuation: Column, shots: Column, delimiter: str) -> Column:
    """The prompt without its continuation, stripped, and the prompt with it; the context is trimmed."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    start = _with_shots(shots, F.concat(bare(context), F.lit(delimiter)))
    return F.array(bare(start), F.concat(start, continuation))


def shared_length(sequences: Column, *, at_end: bool = False) -> Column:
    """How many elements all sequences of an array share at their start, or at their end."""
    first = F.get(sequences, F.lit(0))
    one = lambda s: common_suffix(first, s) if at_end else common_prefix(first, s)
    return F.array_min(F.transform(sequences, one))


def continuation_spans(kind: str, sequences: Column, most: int | None = None) -> Column:
    """(start, stop) of what is scored in each sequence of ids, for choice, schema and continuation prompts; sequences
    longer than most lose their first ids, and spans move along."""
    n = F.size(F.get(sequences, F.lit(0)))
    if kind == "choice":
        start = shared_length(sequences)
        spans = F.transform(sequences, lambda s: F.struct(start.alias("start"), F.size(s).alias("stop")))
    elif kind == "schema":
        end = shared_length(sequences, at_end=True)
        spans = F.transform(sequences, lambda s: F.struct((F.size(s) - end).alias("start"), F.size(s).alias("stop")))
    elif kind == "continuation":
        spans = F.array(F.struct(n.alias("start"), F.size(F.get(sequences, F.lit(1))).alias("stop")))
    else:
        raise ValueError(kind)
    if most is None:
        return spans
    cut = lambda x: F.greatest(x["stop"] - most, F.lit(0))
    return F.transform(spans, lambda x: F.struct(F.greatest(x["start"] - cut(x), F.lit(0)).alias("start"), (x["stop"] - cut(x)).alias("stop")))


def program_source(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    """The program that checks a completion (to be run elsewhere, if at all): imports, code, test and its call."""
    return F.concat(leading_imports(prompt), F.lit("\n\n"), program(completion), F.lit("\n\n"), test, F.lit("\ncheck("), entry_point, F.lit(")"))
