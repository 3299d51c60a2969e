"""Column expressions that cut SQL text into tokens, dialect by dialect.

One pattern a dialect knows its comments, literals and quoted names, so each mark counts where it stands: a
quote in a comment opens nothing, and ``*/`` outside a comment is two operators. All unbounded
repetitions are possessive, which Java matches in a loop, so matching needs a fixed amount of stack
however long a name, literal or comment is.

Comments that hold comments need a counter, which no pattern has. Only texts that hold one go
through ``flat_comments``: a fold over the marks of the text that carries the state of the lexer
and how deep it is in comments, and leaves the comments out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r" \t\r\n\f\x0B"


@dataclass(frozen=True)
class Lexis:
    """What a dialect's lexer accepts besides the common marks."""

    double_quoted: bool = False  # "text" is a string, not a name
    backslash: bool = False  # \' does not end a string
    brackets: bool = False  # [a name]
    hash_comment: bool = False  # from # to the end of the line
    hash_name: bool = False  # a name may begin with #
    dollar_quoted: bool = True  # $tag$ text $tag$
    dollar_name: bool = False  # a name may begin with $
    triple: bool = False  # three quotes open a string, which three end
    dash_blank: bool = False  # -- opens a comment only before a blank


# The lexical rules of the dialects.
LEXES = {
    "generic": Lexis(hash_name=True),
    "ansi": Lexis(),
    "postgresql": Lexis(),
    "mysql": Lexis(double_quoted=True, backslash=True, hash_comment=True, dollar_quoted=False, dollar_name=True, dash_blank=True),
    "mssql": Lexis(brackets=True, hash_name=True),
    "bigquery": Lexis(double_quoted=True, backslash=True, hash_comment=True, triple=True),
    "sqlite": Lexis(brackets=True),
}

TAG = r"\$(?:[\p{L}_][\p{L}\p{N}_]*+)?+\$"
PARTED = rf"[{BLANK}]\.|\.[{BLANK}]"
NESTED = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*"


def _quoted(mark: str, backslash: bool) -> str:
    escape = r"|\\[\s\S]" if backslash else ""
    return rf"{mark}(?:[^{mark}{chr(92) * 2 if backslash else ''}]++{escape}|{mark}{mark})*+{mark}"


def _name(lex: Lexis) -> str:
    """One part of a dotted name."""
    start = r"\p{L}_@" + "#" * lex.hash_name + "$" * lex.dollar_name
    parts = [rf"[{start}][\p{{L}}\p{{N}}_$@{'#' * lex.hash_name}]*+", _quoted("`", False)]
    if not lex.double_quoted:
        parts.append(_quoted('"', False))
    if lex.brackets:
        parts.append(r"\[(?:[^\]]++|\]\])*+\]")
    return "|".join(parts)


def token_pattern(lex: Lexis) -> str:
    """Regular expression for one token or comment. A comment or dollar quote without an end takes the rest."""
    name, blanks = _name(lex), f"[{BLANK}]*+"
    comment = [rf"--{r'(?!\S)' if lex.dash_blank else ''}[^\n]*+", r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+"]
    strings = ["[eE]" + _quoted("'", True), _quoted("'", lex.backslash)]
    if lex.hash_comment:
        comment.append(r"#[^\n]*+")
    if lex.double_quoted:
        strings.append(_quoted('"', lex.backslash))
    if lex.triple:
        strings = [rf"{q * 3}(?:[^{q}\\]++|\\[\s\S]|{q}(?!{q}{q}))*+{q * 3}" for q in ("'", '"')] + strings
    if lex.dollar_quoted:
        strings.append(rf"(?<tag>{TAG})(?:[\s\S]*?\k<tag>|[\s\S]*+)")
    return "|".join([
        *comment, *strings,
        rf"(?:{name})(?:{blanks}\.{blanks}(?:{name}))*+(?:{blanks}\.{blanks}\*)?+",
        r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?",
        r"<=>|->>|<=|>=|<>|!=|==|\|\||::|->|=>|:=",
        rf"[^{BLANK}]",
    ])


def _marks(triple: str, dash: str) -> Column:
    """Regular expression for a mark that may change the lexer's state, or for a run between two marks."""
    return F.lit(rf"{TAG}|{triple}/\*|\*/|{dash}|\\[\\'\"]|[\p{{L}}\p{{N}}_@]++|[{BLANK}&&[^\n]]++|[\s\S]")


LINE, BLOCK, HELD = "line", "block", 4096


def speaks(dialect: Column, what: str) -> Column:
    return dialect.isin([name for name, lex in LEXES.items() if getattr(lex, what)])


def flat_comments(sql: Column, dialect: Column) -> Column:
    """The text without its comments, however deep they are nested; an open one leaves ``/*`` at the end.

    ``mode`` is empty in code, LINE or BLOCK in a comment, else the mark that ends the quote. Pieces are
    gathered in ``tail``, and added to ``out`` a few thousand characters at a time.
    """
    does = lambda what: speaks(dialect, what)
    empty = F.lit("")
    start = F.struct(empty.alias("mode"), F.lit(0).alias("depth"), F.lit(False).alias("escapes"),
                     empty.alias("prev"), empty.alias("out"), empty.alias("tail"))

    def step(state: Column, piece: Column) -> Column:
        mode, depth, escapes = state["mode"], state["depth"], state["escapes"]
        # a backslash where none escapes is a character of its own
        pair = piece.startswith("\\") & (F.length(piece) == 2) & ~escapes
        mark = F.when(pair, F.substring(piece, 2, 1)).otherwise(piece)
        opened = (
            F.when(mark == "/*", BLOCK)
            .when((mark == "--") | ((mark == "#") & does("hash_comment")), LINE)
            .when(mark.isin("'", '"', "`", "'''", '"""'), mark)
            .when((mark == "[") & does("brackets"), "]")
            .when(mark.startswith("$") & (F.length(mark) > 1) & does("dollar_quoted"), mark)
            .otherwise("")
        )
        then = (
            F.when(mode == "", opened)
            .when(mode == LINE, F.when(mark == "\n", "").otherwise(LINE))
            .when(mode == BLOCK, F.when((mark == "*/") & (depth == 1), "").otherwise(BLOCK))
            .otherwise(F.when(mark == mode, "").otherwise(mode))
        )
        deeper = F.when((mark == "/*") & mode.isin("", BLOCK), depth + 1).when((mark == "*/") & (mode == BLOCK), depth - 1).otherwise(depth)
        # the quote that follows one at once goes on with the same string
        by_backslash = does("backslash") | state["prev"].isin("e", "E") | escapes
        kept = (
            F.when(mode == BLOCK, "").when(mode == LINE, F.when(mark == "\n", mark).otherwise(""))
            .when((mode == "") & ((mark == "/*") | (mark == "--") | ((mark == "#") & does("hash_comment"))), " ")
            .otherwise(piece)
        )
        full = F.length(state["tail"]) > HELD
        return F.struct(
            then.alias("mode"), deeper.alias("depth"),
            F.when(mode == "", mark.isin("'", '"', "'''", '"""') & by_backslash).otherwise(escapes).alias("escapes"), piece.alias("prev"),
            F.when(full, F.concat(state["out"], state["tail"])).otherwise(state["out"]).alias("out"),
            F.concat(F.when(full, "").otherwise(state["tail"]), kept).alias("tail"),
        )

    finish = lambda s: F.concat(s["out"], s["tail"], F.when(s["mode"] == BLOCK, "/*").otherwise(""))
    marks = F.when(does("triple"), _marks("'''|\"\"\"|", "--")).when(does("dash_blank"), _marks("", r"--(?!\S)")).otherwise(_marks("", "--"))
    return F.aggregate(F.regexp_extract_all(sql, marks, F.lit(0)), start, step, finish)


def flat_text(sql: Column, dialect: Column) -> Column:
    """The text; without its comments where some hold others."""
    return F.when(sql.rlike(NESTED), flat_comments(sql, dialect)).otherwise(sql)


def lexemes(flat: Column, dialect: Column) -> Column:
    """All tokens and comments of a text in order, as they are written."""
    found = None
    for name, lex in LEXES.items():
        own = F.regexp_extract_all(flat, F.lit(token_pattern(lex)), F.lit(0))
        found = F.when(dialect == name, own) if found is None else found.when(dialect == name, own)
    return found


def token_array(found: Column, flat: Column, dialect: Column) -> Column:
    """The tokens among ``found``, comments dropped; dotted names without the blanks around their dots."""
    comment = lambda t: (
        t.startswith("--") | (t.startswith("/*") & t.endswith("*/") & (F.length(t) > 3))
        | (t.startswith("#") & speaks(dialect, "hash_comment"))
    )
    part = F.lit(rf"{_name(Lexis(brackets=True, hash_name=True, dollar_name=True))}|\*")
    joined = lambda t: F.when(
        t.rlike(PARTED) & t.rlike(r"^[^'0-9/]"), F.array_join(F.regexp_extract_all(t, part, F.lit(0)), ".")
    ).otherwise(t)
    dotted = flat.rlike(PARTED) & ~flat.rlike(r"\$[^$]*\$")
    kept = F.filter(found, lambda t: ~comment(t))
    return F.when(dotted, F.transform(kept, joined)).otherwise(kept)


def token_kind(tok: Column, dialect: Column) -> Column:
    """str, num, path (dotted name or word), op, or bad (a quote that never closes)."""
    first, size = F.substring(tok, 1, 1), F.length(tok)
    closed = tok.rlike(r"^(\$[^$]*\$)[\s\S]*\1$")
    return (
        F.when(first.isin("'", '"', "`") & (size == 1), "bad")
        .when((first == "'") | (first.isin("e", "E") & (F.substring(tok, 2, 1) == "'")), "str")
        .when(first == '"', F.when(speaks(dialect, "double_quoted"), "str").otherwise("path"))
        .when(tok.rlike(r"^[\p{L}_@`]") | (first.isin("[", "#") & (size > 1)), "path")
        .when((first == "$") & (size > 1), F.when(speaks(dialect, "dollar_name"), "path").when(closed, "str").otherwise("bad"))
        .when(tok.rlike(r"^\.?[0-9]"), "num")
        .otherwise("op")
    )
