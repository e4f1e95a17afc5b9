"""A lexer and a nesting tree for code in eleven languages, as a table.

``lexed`` reads each file once, as one automaton over its characters that knows the language's comments, strings and
brackets, and gives a row for every statement and, where asked, every word of code. A statement's text is its own: comments
and strings are blanks of the same length, and what is inside a block of it (braces, an indented suite, .. end) belongs
to the statements in there and shows as {}. Statements are numbered in order of their starts, so that those from number
to last are a statement and all inside it (Euler intervals), and each names the one around it. Everything that follows,
rules, kinds, containment, is done by Spark on these rows (``syntax``).

Where statements end: at ; outside brackets; at the end of a line where the language says so and the line doesn't go on;
after a block. Brackets that don't match are passed over, and whatever is open at the end of a file ends there.

Defined cases: null and empty contents have no rows, languages without a lexer neither; repeated files are files of
their own (a path that several have is read as one file's by what counts within a path). Not told from code: the text
inside JSX tags; interpolated parts of templates count as string.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# How comments and strings are written, by language.
_C = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?s:.))*"?', r"'(?:[^'\\\n]|\\(?s:.))*'?"
_WIDE_DQ, _WIDE_SQ = r'"(?:[^"\\]|\\(?s:.))*"?', r"'(?:[^'\\]|\\(?s:.))*'?"
_TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\}|\$)*`?"
_TRIPLE = r'"""(?:[^\\]|\\(?s:.))*?(?:"""|\Z)'
_LINE_DIRECTIVE = r"^[ \t]*\#(?:[^\n\\]|\\(?s:.))*"
COMMENTS = {"python": r"\#[^\n]*", "ruby": r"\#[^\n]*|^=begin\b(?s:.*?)(?:^=end[^\n]*|\Z)", "php": r"//[^\n]*?(?=\n|\?>|\Z)|\#(?!\[)[^\n]*?(?=\n|\?>|\Z)|/\*(?s:.*?)(?:\*/|\Z)|\?>(?s:.*?)(?:<\?(?:php\b|=)|\Z)|\A(?s:[^<]|<(?!\?))*<\?(?:php\b|=)", "rust": r"//[^\n]*|/\*"}
STRINGS = {
    "python": rf"(?i:[rbuf]{{0,2}})(?:{_TRIPLE}|'''(?:[^\\]|\\(?s:.))*?(?:'''|\Z)|{_DQ}|{_SQ})",
    "rust": rf"[bc]?r(?P<hash>\#*)\"(?s:.*?)(?:\"(?P=hash)|\Z)|[bc]?{_WIDE_DQ}|b?'(?:\\(?s:.)[^'\n]*|[^\\'\n])'",
    "javascript": rf"{_DQ}|{_SQ}|{_TEMPLATE}",
    "go": rf"`[^`]*`?|{_DQ}|{_SQ}",
    "java": rf"{_TRIPLE}|{_DQ}|{_SQ}",
    "cpp": rf"(?:u8|[uUL])?R\"(?P<mark>[^()\\\s]{{0,16}})\((?s:.*?)(?:\)(?P=mark)\"|\Z)|(?:u8|[uUL])?(?:{_DQ}|{_SQ})",
    "csharp": rf"\$*\"\"\"(?s:.*?)(?:\"\"\"+|\Z)|(?:\$@|@\$?)\"(?:[^\"]|\"\")*\"?|\$?{_DQ}|{_SQ}",
    "php": rf"{_WIDE_DQ}|{_WIDE_SQ}",
    "ruby": rf"{_WIDE_DQ}|{_WIDE_SQ}|`[^`]*`?|(?<![\w)\]])%[qQwWiIr]?(?:\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}|<[^<>]*>)",
}
DIRECTIVES = {"cpp": _LINE_DIRECTIVE, "csharp": r"^[ \t]*\#(?!\[)[^\n]*"}
WORDS = {"javascript": r"[^\W\d$][\w$]*|\$[\w$]*", "php": r"\$?[^\W\d]\w*", "ruby": r"(?:@@?|\$)?[^\W\d]\w*(?:[?!](?!=))?", "csharp": r"@?[^\W\d]\w*"}
HEREDOCS = {"ruby": r"<<[~-](?P<q>['\"`]?)(?P<name>[^\W\d]\w*)(?P=q)", "php": r"<<<[ \t]*(?P<q>['\"]?)(?P<name>[^\W\d]\w*)(?P=q)"}
SAME = {"typescript": "javascript", "tsx": "javascript", "c": "cpp"}
#: How statements end: by signs alone, by signs or lines, by indentation, by lines with blocks up to end.
ENDS = {"python": "indent", "ruby": "end", "javascript": "line", "go": "line"}
LANGUAGES = ["python", "rust", "typescript", "tsx", "javascript", "go", "java", "c", "cpp", "csharp", "ruby", "php"]

# Words after which a block's statement goes on, words of Ruby that open a block, and what a line that goes on ends or begins with.
GOES_ON = {"else", "catch", "finally", "from", "until", "as", "satisfies", "of", "in", "instanceof"}
OPENERS = {"def", "class", "module", "if", "unless", "while", "until", "case", "for", "begin"}
OPEN_LINE_ENDS = {"=", ",", ".", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", "=>", "->", "::", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "==", "!=", "<=", ">=", "<", "!", "~", "extends", "implements"}
OPEN_LINE_STARTS = (".", "?", ":", "&", "|", "=", "*", "/", "%", ",", ")", "]", "+", "-")

_SCOPE = re.compile(r"\b(class|struct|interface|enum|trait|impl|record|union|namespace|module|mod)\b")
_FUNCTION = re.compile(r"\b(?:fn|func|def|function)\b|\)\s*(?:const|noexcept|override|final|volatile|&|\s)*$|=>\s*$")
_LITERAL = {"=", "(", ",", ":", "[", "?", "return", "&&", "||", "&", "|"}


def _pattern(language: str) -> re.Pattern:
    of = SAME.get(language, language)
    parts = [("comment", COMMENTS.get(of, _C)), ("directive", DIRECTIVES.get(of)), ("heredoc", HEREDOCS.get(of)), ("string", STRINGS[of])]
    parts += [("word", WORDS.get(of, r"[^\W\d]\w*")), ("number", r"\d(?:[\w.]|'(?=\w))*" if of == "cpp" else r"\d(?:\w|\.(?=\d))*"), ("line", r"\n")]
    parts += [("sign", r"=>|->|::|:=|&&|\|\||[-+*/%&|^<>=!]=|[^\w\s]")]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts if p), re.M)


_PATTERNS: dict[str, re.Pattern] = {}
_NESTED = re.compile(r"/\*|\*/")
_REGEX = re.compile(r"/(?![*/ =])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")


class _Statement:
    __slots__ = ("after_block", "at", "end", "last", "level", "number", "opens", "parens", "parent", "parts", "scope", "start", "word")

    def __init__(self, number: int, level: _Level, start: int):
        self.number, self.level, self.start, self.at, self.end = number, level, start, start, start
        self.parent, self.scope = level.owner.number if level.owner else -1, level.scope
        self.last, self.parts, self.parens, self.after_block, self.opens, self.word = number, [], 0, False, 0, None


class _Level:
    """What is open between two braces (or in a suite): its owner, and the statement being read."""

    __slots__ = ("now", "owner", "scope", "width")

    def __init__(self, owner: _Statement | None, scope: str, width: int = 0):
        self.owner, self.scope, self.now, self.width = owner, scope, None, width


class Reader:
    """One pass over one file: statements and words."""

    def __init__(self, content: str, language: str, words: bool = True):
        self.content, self.language, self.of = content, language, SAME.get(language, language)
        self.ends = ENDS.get(self.of, "sign")
        self.wants_words, self.words, self.done = words, [], []
        self.levels, self.brackets = [_Level(None, "file")], []
        self.count, self.before, self.until, self.blanked, self.pending = 0, None, 0, [], []

    # statements

    def _begin(self, at: int) -> _Statement:
        level = self.levels[-1]
        if level.now is None:
            level.now = _Statement(self.count, level, at)
            self.count += 1
            self.before = None
        return level.now

    def _finish(self, end: int | None = None) -> None:
        s = self.levels[-1].now
        if s is not None:
            s.end = self.until if end is None else end
            s.parts.append((s.at, max(s.at, s.end)))
            s.last = self.count - 1
            self.done.append(s)
            self.levels[-1].now = self.before = None

    def _masked(self, a: int, b: int) -> str:
        """The content from a to b with comments and strings blanked."""
        out, k = [], int(np.searchsorted(self.ends_of_blanks, a, "right")) if self.ends_of_blanks is not None else 0
        while k < len(self.blanked) and self.blanked[k][0] < b:
            x, y = self.blanked[k]
            if x > a:
                out.append(self.content[a:x])
            x, y = max(x, a), min(y, b)
            piece = self.content[x:y]
            out.append("\n".join(" " * len(p) for p in piece.split("\n")) if "\n" in piece else " " * len(piece))
            a, k = y, k + 1
        out.append(self.content[a:b])
        return "".join(out)

    # blocks

    def _open(self, at: int, width: int = 0) -> None:
        s = self._begin(at)
        head = self.content[max(s.at, at - 400) : at]
        if self.before in _LITERAL and self.ends != "end":
            scope = "literal"
        elif self.of == "go" and head.strip() in ("const", "var", "type", "import"):
            scope = head.strip()
        else:
            found = None if _FUNCTION.search(head.rstrip()) else _SCOPE.search(head)
            scope = found[1] if found else "code"
        s.parts.append((s.at, at))
        self.levels.append(_Level(s, scope, width))
        self.before = None

    def _close(self, at: int) -> None:
        """The innermost block ends before at; its owner goes on."""
        self._finish()
        s = self.levels.pop().owner
        s.at, s.after_block, self.until = at, True, at

    def _sign(self, sign: str, at: int, end: int) -> None:
        level = self.levels[-1]
        if sign in "([" or sign == "{" and self.ends == "indent":
            s = self._begin(at)
            if self.of == "go" and sign == "(" and self.content[s.at : at].strip() in ("const", "var", "type", "import"):
                self._open(at)
                self.brackets.append(("(", len(self.levels)))
                return
            s.parens += 1
            self.brackets.append((sign, 0))
        elif sign == "{":
            self._open(at)
            self.brackets.append(("{", len(self.levels)))
        elif sign in ")]" or sign == "}" and self.ends == "indent":
            if self.brackets and self.brackets[-1][1]:
                if sign == ")" and self.brackets[-1][0] == "(":  # a group of declarations
                    self.brackets.pop()
                    self._close(end)
                return
            if self.brackets and level.now is not None and level.now.parens:
                self.brackets.pop()
                level.now.parens -= 1
        elif sign == "}":
            k = next((k for k in range(len(self.brackets) - 1, -1, -1) if self.brackets[k][0] == "{"), None)
            if k is None:
                return
            depth = self.brackets[k][1]
            del self.brackets[k:]
            while len(self.levels) > depth:  # blocks without an end of their own
                self._close(at)
            self._close(end)
        elif sign == ";":
            if level.now is not None and level.now.opens:
                self._suite()
            elif level.now is not None and not level.now.parens:
                self._finish(self.until)
            return
        else:
            self._begin(at)
        self.before, self.until = sign, end

    # ends of lines

    def _suite(self) -> None:
        """Ruby's blocks begin where the line of their head ends."""
        self.levels[-1].now.opens -= 1
        self._open(self.until)

    def _line(self, at: int) -> None:
        s = self.levels[-1].now
        for name in self.pending:  # texts that begin on the next line
            found = re.compile(rf"^[ \t]*{name}\b", re.M).search(self.content, at)
            self.skip = found.end() if found else len(self.content)
            self._blank(at + 1, self.skip)
            at = self.skip
        self.pending = []
        if s is None or s.parens or self.ends == "sign":
            return
        if self.ends == "indent":
            if not (self.content.startswith("@", s.start) and self.before is not None and not re.search(r"\n\s*(?:async\s+def|def|class)\b", self.content[s.start : at])):
                self._finish()
            return
        if s.opens:
            self._suite()
            return
        if self.before in OPEN_LINE_ENDS and not (self.ends == "end" and self.before in ("?", "!", "*", "|")):
            return
        rest = self.content[at : at + 200].lstrip()
        if rest.startswith(OPEN_LINE_STARTS) and not rest.startswith(("//", "/*", "..", "++", "--")) and self.of == "javascript" or self.of == "ruby" and re.match(r"\.\w|&\.", rest):
            return
        if self.of == "javascript" and rest.startswith("{"):
            return
        self._finish()

    def _indent(self, at: int) -> None:
        """Python: the first token of a line says which suites end, or that one begins."""
        width = at - (self.content.rfind("\n", 0, at) + 1)
        while len(self.levels) > 1 and width < self.levels[-1].width:
            self._shut()
        if self.done and self.colon and width > self.levels[-1].width:
            owner = self.done[-1]
            if owner.level is self.levels[-1]:
                self.done.pop()
                self.levels[-1].now, owner.parts = owner, owner.parts[:-1]
                self._open(self.until, width)
        self.colon = False

    def _shut(self) -> None:
        self._finish()
        owner = self.levels.pop().owner
        owner.end, owner.at, owner.last = self.until, self.until, self.count - 1
        self.levels[-1].now = owner
        self._finish()

    # the pass

    def _blank(self, a: int, b: int) -> None:
        if b > a:
            self.blanked.append((a, b))

    def read(self) -> tuple[list[_Statement], list[tuple]]:
        content, size = self.content, len(self.content)
        pattern = _PATTERNS.setdefault(self.language, _pattern(self.language))
        self.ends_of_blanks, self.colon, at, fresh = None, False, 0, True
        open_word = None
        while at < size:
            m = pattern.search(content, at)
            if m is None:
                break
            kind, a, at = m.lastgroup if m.lastgroup not in ("hash", "mark", "q", "name") else self._outer(m), m.start(), m.end()
            self.skip = at
            if kind == "line":
                self._line(a)
                fresh, at = True, max(at, self.skip)
                continue
            if kind == "comment":
                if self.of == "rust" and m[0] == "/*":
                    depth = 1
                    for x in _NESTED.finditer(content, at):
                        depth += 1 if x[0] == "/*" else -1
                        if not depth:
                            break
                    at = x.end() if not depth else size
                self._blank(a, at)
                if self.of == "php" and m[0].startswith("?>"):
                    self._finish(self.until)
                continue
            if kind == "directive":
                if self.levels[-1].now is not None and not self.levels[-1].now.parens:
                    self._finish(self.until)
                if self.levels[-1].now is None:
                    self._begin(a + len(m[0]) - len(m[0].lstrip()))
                    self.until = at
                    self._finish(at)
                continue
            if fresh and self.ends == "indent" and self.levels[-1].now is None:
                self._indent(a)
            fresh = False
            if kind == "sign" and m[0] == "/" and self.of in ("javascript", "ruby") and (self.before is None or self.before in "(,=:[!&|?{};=>||&&return" and self.before != ")"):
                found = _REGEX.match(content, a)
                if found:
                    kind, at = "string", found.end()
            now = self.levels[-1].now
            if now is not None and now.after_block and not now.parens:
                text = m[0]
                goes_on = text in GOES_ON if kind == "word" else kind == "sign" and (text in ".,=?:;)]" or text in ("=>", "&&", "||", "}") or text in "([" and self.ends != "sign")
                if self.ends != "end" and not goes_on and self.ends != "indent":
                    self._finish(self.until)
                now = self.levels[-1].now
                if now is not None:
                    now.after_block = False
            if open_word is not None:
                open_word[4] = "=" if kind == "sign" and m[0] == "=" else m[0] if kind == "sign" else "word" if kind in ("word", "number") else kind
                open_word = None
            if kind == "sign":
                self._sign(m[0], a, at)
                self.colon = m[0] == ":" and not (self.levels[-1].now is not None and self.levels[-1].now.parens)
                continue
            self.colon = False
            if kind == "word" and self.ends == "end" and self._ruby(m[0], a, at):
                continue
            s = self._begin(a)
            if kind == "word":
                if self.wants_words:
                    open_word = [s.number, m[0], a, self.before, None, self.brackets[-1][0] if self.brackets and not self.brackets[-1][1] else "", s.scope]
                    self.words.append(open_word)
                self.before = m[0]
            elif kind in ("string", "heredoc"):
                if kind == "heredoc":
                    self.pending.append(m["name"])
                self._blank(a, at)
                self.before = '""'
            else:
                self.before = "0"
            self.until = at
        while len(self.levels) > 1:
            if self.ends == "indent":
                self._shut()
            else:
                self._close(self.until)
        self._finish()
        return self.done, self.words

    def _outer(self, m: re.Match) -> str:
        return "heredoc" if "name" in m.re.groupindex and m["name"] else "string"

    def _ruby(self, word: str, a: int, at: int) -> bool:
        """Words that open and end blocks; True where the word is done with."""
        now, level = self.levels[-1].now, self.levels[-1]
        if self.before in (".", "&.", "::", ":") and now is not None:
            return False
        if word == "end":
            if now is not None and now.opens:
                now.opens -= 1
            elif len(self.levels) > 1 and next((depth for _, depth in reversed(self.brackets) if depth), 0) < len(self.levels):
                self._finish()
                owner = self.levels.pop().owner
                owner.at, self.until = at, at
                self.before = word
                return True
            self.until = at
            return now is None
        if word == "then" and now is not None and now.opens:
            self._suite()
            self.until = at
            return True
        if word in ("else", "elsif", "when", "rescue", "ensure", "in") and level.owner is not None and now is None:
            return False
        if word in OPENERS and (now is None or self.before in ("=", "(", ",", "[", "return", "||", "&&", "||=", "<<")) or word == "do" and not (now is not None and now.word in ("while", "until", "for")):
            s = self._begin(a)
            if word != "def" or not re.match(r"def\s+[\w.?!=]+(?:\([^)\n]*\))?\s+=\s", self.content[a : a + 300]):
                s.opens += 1
            s.word = s.word or word
        elif now is None:
            self._begin(a).word = word
        return False

    def rows(self) -> tuple[list[tuple], list[tuple]]:
        """(number, parent, last, scope, text, start, end) of statements; (statement, word, place, before, after, inside, scope) of words."""
        done, words = self.read()
        self.blanked.sort()
        self.ends_of_blanks = np.array([b for _, b in self.blanked], np.int64)
        done.sort(key=lambda s: s.number)
        return [(s.number, s.parent, s.last, s.scope, "{}".join(self._masked(a, b) for a, b in s.parts), s.start, s.end) for s in done], words


SCHEMA = "path string, language string, what string, node int, parent int, last int, scope string, text string, before string, after string, inside string, sl int, sc int, el int, ec int"


NUMBERS = (3, 4, 5, 11, 12, 13, 14)
#: Rows of a batch that the lexer gives, at least; the last one has fewer.
ROWS = 4096
#: Tasks that files are dealt to for each core: files of code are small in Parquet and dear to read.
TASKS = 4


def _tasks(spark: SparkSession) -> int:
    return max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lexed(files: DataFrame, words: bool = True) -> DataFrame:
    """SCHEMA of files (path, language, content): what is 'statement' or 'word'; places count lines and characters from 1."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(path: str, language: str, content: str) -> list[list]:
        statements, found = Reader(content, language, words).rows()
        breaks, at = [-1], content.find("\n")
        while at >= 0:
            breaks.append(at)
            at = content.find("\n", at + 1)

        def place(at: list[int]) -> tuple[list[int], list[int]]:
            line = [bisect_left(breaks, x) for x in at]
            return line, [x - breaks[k - 1] for x, k in zip(at, line, strict=True)]

        n, w = len(statements), len(found)
        sl, sc = place([s[5] for s in statements] + [x[2] for x in found])
        el, ec = place([s[6] for s in statements] + [x[2] + len(x[1]) for x in found])
        none_n, none_w = [None] * n, [None] * w
        return [
            [path] * (n + w), [language] * (n + w), ["statement"] * n + ["word"] * w, [s[0] for s in statements] + [x[0] for x in found], [s[1] for s in statements] + none_w, [s[2] for s in statements] + none_w, [s[3] for s in statements] + [x[6] for x in found],
            [s[4] for s in statements] + [x[1] for x in found], none_n + [x[3] for x in found], none_n + [x[4] for x in found], none_n + [x[5] for x in found],
            sl, sc, el, ec,
        ]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in NUMBERS else pa.string()) for k, c in enumerate(columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in names]
        for b in batches:
            for path, language, content in zip(*(b.column(k) for k in range(3)), strict=True):
                content, language = content.as_py(), language.as_py()
                if content and language in LANGUAGES:
                    for c, more in zip(columns, rows(path.as_py(), language, content), strict=True):
                        c.extend(more)
                    if len(columns[0]) >= ROWS:
                        yield batch(columns)
                        columns = [[] for _ in names]
        if columns[0]:
            yield batch(columns)

    files = files.select("path", "language", "content")
    return files.repartition(_tasks(files.sparkSession)).mapInArrow(run, SCHEMA)
