"""A Doris-like SQL dialect on top of Spark SQL: what Spark writes differently is rewritten, the rest passes through."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"""(\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\d+(?:\.\d+)?|[A-Za-z_]\w*|<=>|>=|<=|<>|!=|\|\||->|::|.)""", re.S)
# Functions that have another name in Spark.
FUNCTIONS = {
    "array_match_any": "exists", "array_match_all": "forall", "group_concat": "string_agg", "json_extract": "get_json_object", "get_json_string": "get_json_object",
    "ndv": "approx_count_distinct", "str_to_date": "try_to_timestamp", "days_add": "date_add", "days_sub": "date_sub", "element_at": "try_element_at",
}
#: Below these columns the rest of a path is one key with dots.
DOTTED_KEYS = ("resource", "attributes")


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _next(ts: list[str], i: int, step: int = 1) -> int:
    i += step
    while 0 <= i < len(ts) and ts[i].isspace():
        i += step
    return i


class Literals:
    """Text literals taken out of a statement, so that no rewriting touches what they say; ``__lit0__`` and so on stand for them."""

    def __init__(self) -> None:
        self.texts: list[str] = []

    def keep(self, text: str) -> str:
        self.texts.append(text)
        return f"__lit{len(self.texts) - 1}__"

    def out(self, sql: str) -> str:
        return "".join(self.keep(t) if t[0] in "'\"" and len(t) > 1 else t for t in tokens(sql))

    def back(self, sql: str) -> str:
        return re.sub(r"__lit(\d+)__", lambda m: self.texts[int(m[1])], sql)


def _limit(sql: str) -> str:
    """LIMIT a, b as LIMIT b OFFSET a."""
    return re.sub(r"(?i)\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", sql)


def _xor(sql: str) -> str:
    return re.sub(r"(?i)(\([^()]*\)|\w+(?:\s*(?:=|<>|<|>|<=|>=)\s*(?:'[^']*'|\w+))?)\s+xor\s+(\([^()]*\)|\w+(?:\s*(?:=|<>|<|>|<=|>=)\s*(?:'[^']*'|\w+))?)", r"((\1) <> (\2))", sql)


def _match(sql: str, literals: Literals) -> str:
    """MATCH_PHRASE, MATCH_PHRASE_PREFIX, MATCH_PHRASE_EDGE, MATCH_ANY, MATCH_ALL as regular expressions over lower-case text."""

    def made(m: re.Match) -> str:
        column, op, text = m[1], m[2].upper(), literals.texts[int(m[3])][1:-1].replace("''", "'")
        words = [re.escape(w) for w in re.findall(r"\w+", text.lower())]
        if not words:
            return "false"
        join = r"\W+".join(words)
        word = lambda w: rf"(^|\W){w}(\W|$)"
        pattern = {"MATCH_PHRASE": word(join), "MATCH_PHRASE_PREFIX": rf"(^|\W){join}", "MATCH_PHRASE_EDGE": join, "MATCH_ANY": word("(" + "|".join(words) + ")")}.get(op)
        patterns = [word(w) for w in words] if op == "MATCH_ALL" else [pattern]
        return "(" + " AND ".join("lower({}) RLIKE {}".format(column, literals.keep("r'" + p.replace("'", "''") + "'")) for p in patterns) + ")"

    return re.sub(r"(?i)([\w.`\[\]']+)\s+(MATCH_PHRASE_PREFIX|MATCH_PHRASE_EDGE|MATCH_PHRASE|MATCH_ANY|MATCH_ALL)\s+__lit(\d+)__", made, sql)


def _at_top(sql: str, words: str, begin: int = 0) -> int:
    """Where one of the words (alternatives of a regular expression) stands outside brackets and quotes; -1 if nowhere."""
    depth, at = 0, 0
    for t in _TOKEN.findall(sql):
        depth += (t == "(") - (t == ")")
        if not depth and at >= begin and re.match(rf"(?is)(?:{words})\b", sql[at:]) and re.match(r"\w", t):
            return at
        at += len(t)
    return -1


def _qualify(sql: str) -> str:
    """SELECT ... QUALIFY c as a filter over a subquery that computes the windows."""
    at = _at_top(sql, "qualify")
    if at < 0:
        return sql
    begin = _at_top(sql, "select")
    end = _at_top(sql, r"order\s+by|limit", at)
    end = len(sql) if end < 0 else end
    head, body, condition, tail = sql[:begin], sql[begin:at].strip(), sql[at + 7 : end].strip(), sql[end:]
    if not re.search(r"(?i)\bover\b", condition):  # over the select list's own names
        return f"{head}SELECT * FROM ({body}) WHERE {condition} {tail}"
    body = re.sub(r"(?is)^select\b", f"SELECT ({condition}) AS __qualified, ", body, count=1)
    return f"{head}SELECT * EXCEPT (__qualified) FROM ({body}) WHERE __qualified {tail}"


def _joins(sql: str) -> str:
    """a RIGHT SEMI|ANTI JOIN b ON c as b LEFT SEMI|ANTI JOIN a ON c."""
    return re.sub(r"(?is)\bfrom\s+([\w.`]+(?:\s+(?:as\s+)?(?!right\b)\w+)?)\s+right\s+(semi|anti)\s+join\s+([\w.`]+(?:\s+(?:as\s+)?(?!on\b|using\b)\w+)?)\s+(on|using)\b", r"FROM \3 LEFT \2 JOIN \1 \4", sql)


def _functions(sql: str) -> str:
    ts = tokens(sql)
    for i, t in enumerate(ts):
        low = t.lower()
        j = _next(ts, i)
        called = j < len(ts) and ts[j] == "("
        if called and low in FUNCTIONS:
            ts[i] = FUNCTIONS[low]
        elif low in ("signed", "unsigned") and i and ts[_next(ts, i, -1)].lower() in ("as", ","):
            ts[i] = "BIGINT" if low == "signed" else "DECIMAL(20,0)"
        elif low == "largeint":
            ts[i] = "DECIMAL(38,0)"
        elif low in ("datetime", "datetimev2") and ts[_next(ts, i, -1)].lower() == "as":
            ts[i] = "TIMESTAMP"
        elif low in ("text", "varchar") and ts[_next(ts, i, -1)].lower() == "as" and not called:
            ts[i] = "STRING"
        elif low == "regexp" and ts[_next(ts, i, -1)].lower() not in (",", "("):
            ts[i] = "RLIKE"
    return "".join(ts)


def _lambdas(sql: str) -> str:
    """array_match_any(x -> p, a) as exists(a, x -> p)."""
    return re.sub(r"(?i)\b(exists|forall|transform|filter)\s*\(\s*(\w+)\s*->\s*([^,]+?)\s*,\s*([\w.`]+)\s*\)", r"\1(\4, \2 -> \3)", sql)


def object_paths(sql: str, objects: dict[str, str]) -> str:
    """a.b.c of the columns in ``objects`` (name: 'variant' or 'map') as typed access. CAST(a.b.c AS t) takes the type; a bare path is a text."""

    def path(name: str, rest: list[str]) -> list[str]:
        for k, part in enumerate([name, *rest]):
            if part in DOTTED_KEYS:
                return rest[:k] + ([".".join(rest[k:])] if rest[k:] else [])
        return rest

    def made(m: re.Match, kind: str = "string") -> str:
        name, *rest = m[0].split(".") if "(" not in m[0] else m[1].split(".")
        if name not in objects or not rest:
            return m[0]
        keys = path(name, rest)
        if objects[name] == "map":
            text = f"try_element_at({name}, '{'.'.join(keys)}')"
            return text if kind == "string" else f"CAST({text} AS {kind})"
        steps = "".join(f'["{k}"]' for k in keys)
        return f"try_variant_get({name}, '${steps}', '{kind}')"

    names = "|".join(map(re.escape, objects)) or r"(?!)"
    sql = re.sub(rf"(?i)cast\(\s*((?:{names})(?:\.\w+)+)\s+as\s+(\w+)\s*\)", lambda m: made(m, m[2]), sql)
    return re.sub(rf"(?<![\w.'$\[(])(?:{names})(?:\.\w+)+(?!\w)(?![^']*'\s*,\s*'\$)", made, sql) if objects else sql


def spark_sql(sql: str, objects: dict[str, str] | None = None) -> str:
    """A text of the dialect as Spark SQL."""
    literals = Literals()
    out = literals.out(sql.strip().rstrip(";"))
    for step in (_limit, lambda x: _match(x, literals), _joins, _functions, _lambdas, _xor, _qualify):
        out = step(out)
    return literals.back(object_paths(out, objects or {}))


# Words that end a FROM clause, and words that can follow a relation without being its alias.
_ENDS_FROM = frozenset("select where group order having limit offset qualify window union intersect except minus values cluster distribute sort".split())
_NO_ALIAS = _ENDS_FROM | frozenset("join on using left right inner full cross outer semi anti natural lateral tablesample pivot unpivot for timestamp version".split())
_NO_RELATION = frozenset("select with values from lateral table".split())


def inject(sql: str, table: str, condition: str) -> str:
    """The same query where every use of ``table`` sees only the rows of ``condition``: after FROM, JOIN, TABLE or a comma, in brackets, in subqueries and in common table
    expressions, with or without a qualifier or backquotes. Not touched are literals, comments, columns, other tables, table functions, and names that a common table expression has taken."""
    ts = [t for t in tokens(sql)]
    out: list[str] = []
    # Of each open bracket: whether a FROM clause is open, whether a relation comes next, names that CTEs have taken, whether a WITH list is open, the CTE being defined in it, the word before, and the word that the bracket follows.
    frames = [{"from": False, "next": False, "taken": frozenset(), "with": False, "cte": None, "word": "", "call": ""}]
    i = 0
    plain = lambda t: t.strip("`").lower()
    while i < len(ts):
        t, f = ts[i], frames[-1]
        low = t.lower()
        if t.isspace():
            out.append(t)
        elif t == "(":
            j = _next(ts, i)
            inner = ts[j].lower() if j < len(ts) else ""
            relation = f["next"] and inner not in _NO_RELATION
            frames.append({"from": relation, "next": relation, "taken": f["taken"], "with": False, "cte": None, "word": "", "call": f["word"]})
            f["next"] = False
            out.append(t)
        elif t == ")":
            if len(frames) > 1:
                frames.pop()
            f = frames[-1]
            if f["with"] and f["cte"] and f["defined"]:
                f["taken"], f["cte"] = f["taken"] | {f["cte"]}, None
            out.append(t)
        elif t == ",":
            f["next"] = f["from"]
            out.append(t)
        elif low == "with" and not f["from"]:
            f["with"], f["cte"] = True, None
            out.append(t)
        elif f["with"] and f["cte"] is None and low not in ("recursive",) and re.match(r"[\w`]", t) and low not in ("select", "from", "values", "table"):
            f["cte"], f["defined"] = plain(t), False
            out.append(t)
        elif f["with"] and low == "as":
            f["defined"] = True
            out.append(t)
        elif low in ("from", "join", "table"):
            before = ts[_next(ts, i, -1)].lower() if _next(ts, i, -1) >= 0 else ""
            function = f["call"] in ("extract", "trim", "substring", "substr", "overlay", "position") and len(frames) > 1 and not f["from"]
            if not (low == "from" and (before == "distinct" and ts[_next(ts, _next(ts, i, -1), -1)].lower() in ("is", "not") or function)):
                f["from"] = f["next"] = True
                f["with"] = False
            out.append(t)
        elif low in _ENDS_FROM:
            f["from"] = f["next"] = f["with"] = False
            out.append(t)
        elif f["next"] and low == "lateral":
            f["next"] = False
            out.append(t)
        elif f["next"] and re.match(r"[\w`]", t):
            f["next"] = False
            last = i
            while (j := _next(ts, last)) < len(ts) and ts[j] == "." and (k := _next(ts, j)) < len(ts):
                last = k
            name = "".join(ts[i : last + 1])
            after = _next(ts, last)
            following = ts[after].lower() if after < len(ts) else ""
            mine = plain(ts[last]) == table.lower() and following != "(" and not (last == i and plain(t) in f["taken"])
            if mine:
                has_alias = following == "as" or re.match(r"[a-z_`]", following) and following not in _NO_ALIAS
                alias = "" if has_alias or following == "tablesample" else f" AS {ts[last]}"
                out.append(f"(SELECT * FROM {name} WHERE {condition}){alias}")
            else:
                out.append(name)
            i = last
        else:
            out.append(t)
        if re.match(r"\w", t):
            frames[-1]["word"] = low
        elif not t.isspace() and t != "(":
            frames[-1]["word"] = ""
        i += 1
    return "".join(out)


def clamp_limit(sql: str, most: int) -> str:
    """The outermost LIMIT at most ``most``; one is added if there is none. Comments are left out."""
    sql = "".join(tokens(sql)).strip()
    m = re.search(r"(?is)\blimit\s+(\d+)(\s+offset\s+\d+)?\s*$", sql)
    if not m:
        return f"{sql} LIMIT {most}"
    return sql[: m.start()] + f"LIMIT {min(int(m[1]), most)}{m[2] or ''}"


# Statements that a query engine of this kind reads but doesn't run.
_REFUSED = ("insert", "update", "delete", "drop", "alter", "truncate", "export", "load", "grant", "revoke", "create")


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, objects: dict[str, str] | None = None, most: int | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Run a query of the dialect; statements that change data are refused. ``filters``: conditions that hold wherever a table is used. ``most``: so many rows at most, whatever the text says."""
    ts = [t for t in tokens(sql) if not t.isspace()]
    if ts and ts[0].lower() in _REFUSED:
        raise PermissionError(f"{ts[0].upper()} isn't a query")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    for name, condition in (filters or {}).items():
        sql = inject(sql, name, condition)
    out = spark.sql(spark_sql(sql, objects))
    return out.limit(most) if most is not None else out
