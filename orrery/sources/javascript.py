"""Facts of JavaScript and TypeScript files (S3a): symbols, imports, bindings, exports, calls, base classes.

One scan of each file gives all its facts as rows of one table; linking files to one another is the work of joins
(`orrery.operators.linking`). A file that is null or has no code gives no facts.

Columns: file, fact, line, end_line, name, kind, owner, spec, imported, type_only, exported, top, caller.
fact: symbol (kind, space in `imported`), import (spec, kind), binding (name = imported of spec), export (name, kind), call (name, kind, owner = receiver), base (name).
Lines count from 1. A call's or base's `caller` is the innermost symbol around its line, as name@line, null outside all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from orrery.sources.lexer import COMMENT, MARK, NAME, STRING, Lines, mask, tokens

FACTS = "file string, fact string, line int, end_line int, name string, kind string, owner string, spec string, imported string, type_only boolean, exported boolean, top boolean, caller string"
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in FACTS.split(", ")])

#: Words of the language that a parenthesis may follow without a call.
_WORDS = {
    "if", "for", "while", "switch", "catch", "return", "typeof", "void", "delete", "throw", "new", "await", "yield", "in", "do", "else", "case", "super", "import", "function", "class",
    "export", "default", "extends", "const", "let", "var", "async", "with", "instanceof", "this",
}
_MODIFIERS = {"async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "*", "accessor"}
_CONTINUES = {",", "=", "(", "[", "{", ".", "?.", "?", ":", "+", "-", "*", "/", "%", "&", "|", "^", "<", "=>", "!", "~"}
_TYPESCRIPT = (".ts", ".tsx")


class _Source:
    """The code tokens of a file, with the partner of every bracket."""

    def __init__(self, file: str, text: str):
        lines = Lines(text)
        code = [t for t in tokens(text) if t[0] != COMMENT]
        self.kind = [k for k, _, _ in code] + [""] * 3
        self.text = [text[a:b] for _, a, b in code] + [""] * 3
        self.line = [lines.of(a) for _, a, _ in code]
        self.last = [lines.of(b - 1) for _, _, b in code]
        self.n = len(code)
        self.typescript = file.endswith(_TYPESCRIPT)
        self.close, self.depth, self.braces = {}, [], []  # braces: the innermost open brace of each token, -1 outside
        stack: list[int] = []
        inner = [-1]
        pair = {")": "(", "]": "[", "}": "{"}
        for i in range(self.n):
            s = self.text[i] if self.kind[i] == MARK else ""
            if s in pair:
                while stack and self.text[stack[-1]] != pair[s]:
                    stack.pop()
                    inner.pop()
                if stack:
                    self.close[stack.pop()] = i
                    inner.pop()
            self.depth.append(len(stack))
            self.braces.append(inner[-1])
            if s in ("(", "[", "{"):
                stack.append(i)
                inner.append(i if s == "{" else inner[-1])
        for b in stack:
            self.close[b] = self.n - 1
        self.open = {b: a for a, b in self.close.items()}

    def is_(self, i: int, *what: str) -> bool:
        return 0 <= i < self.n and self.kind[i] in (MARK, NAME) and self.text[i] in what

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == NAME

    def string(self, i: int) -> str | None:
        return self.text[i][1:-1] if 0 <= i < self.n and self.kind[i] == STRING else None

    def after_types(self, i: int) -> int:
        """The token after <...> at i, or i."""
        if not self.is_(i, "<"):
            return i
        open_ = 0
        for j in range(i, min(self.n, i + 400)):
            open_ += self.is_(j, "<") - self.is_(j, ">")
            if open_ == 0:
                return j + 1
        return i

    def starts(self, i: int) -> bool:
        """Whether a declaration at i stands as a statement, after its modifiers."""
        while self.is_(i - 1, "export", "default", "async", "declare", "abstract", "const"):
            i -= 1
        if i == 0 or self.is_(i - 1, ";", "{", "}", ")"):
            return True
        return self.line[i] > self.last[i - 1] and not self.is_(i - 1, *_CONTINUES)

    def exported(self, i: int) -> str | None:
        """`export`, `default` or None by the modifiers before i."""
        default = False
        while self.is_(i - 1, "export", "default", "async", "declare", "abstract", "const"):
            i -= 1
            default |= self.is_(i, "default")
            if self.is_(i, "export"):
                return "default" if default else "export"
        return None

    def ends(self, i: int) -> int:
        """The last token of the declarator that starts at i, on its own depth."""
        j, depth = i, self.depth[i]
        while j + 1 < self.n:
            j = self.close.get(j, j)
            k = j + 1
            if k >= self.n or self.depth[k] < depth or self.is_(k, ";", ",", ")", "]", "}"):
                return j
            if self.line[k] > self.last[j] and not self.is_(j, *_CONTINUES) and not self.is_(k, *_CONTINUES):
                return j
            j = k
        return min(j, self.n - 1)

    def braced(self, i: int) -> list[tuple[int, str, str, bool]]:
        """(token, name, renamed, type only) of {a, b as c, d: e, type f} from the brace at i; other shapes are left out."""
        out, j, end = [], i + 1, self.close.get(i, self.n)
        while j < end:
            k = j
            while k < end and not self.is_(k, ","):
                k = self.close[k] + 1 if k in self.close else k + 1
            words = range(j, min(k, end))
            typed = len(words) in (2, 4) and self.is_(j, "type") and self.name(j + 1)
            own = list(words)[typed:]
            if len(own) == 1 and self.name(own[0]):
                out.append((own[0], self.text[own[0]], self.text[own[0]], typed))
            elif len(own) == 3 and self.is_(own[1], "as", ":") and (self.name(own[0]) or self.string(own[0])) and self.name(own[2]):
                out.append((own[0], self.string(own[0]) or self.text[own[0]], self.text[own[2]], typed))
            elif len(own) > 2 and self.name(own[0]) and self.is_(own[1], "="):  # a default value in a pattern
                out.append((own[0], self.text[own[0]], self.text[own[0]], False))
            j = k + 1
        return out


def facts_of(file: str, text: str | None) -> list[dict]:
    """All facts of one file."""
    s = _Source(file, text or "")
    out: list[dict] = []
    classes: dict[int, str | None] = {}  # opening brace of a class body: the class
    silent: set[int] = set()  # braces of interfaces: nothing in them is called
    marked: set[str] = set()  # names exported apart from their declaration

    def fact(fact: str, i: int, name: str | None = None, **more) -> dict:
        row = dict.fromkeys(_COLUMNS) | {"file": file, "fact": fact, "line": s.line[i], "name": name} | more
        out.append(row)
        return row

    def symbol(i: int, end: int, kind: str, space: str, keyword: int, owner: str | None = None, exported: bool | None = None) -> None:
        how = s.exported(keyword) if exported is None else None
        fact("symbol", i, s.text[i], kind=kind, end_line=s.last[min(end, s.n - 1)], owner=owner, imported=space, exported=bool(how) if exported is None else exported, top=s.depth[i] == 0)
        if how:
            fact("export", keyword, "default" if how == "default" else s.text[i], kind="local", imported=s.text[i], type_only=space == "type")

    def bind(i: int, local: str, imported: str, spec: str, typed: bool = False) -> None:
        fact("binding", i, local, imported=imported, spec=spec, type_only=typed)

    def head(i: int) -> int:
        """The opening brace of a declaration whose head starts at i, or the token before its end."""
        while i < s.n and not s.is_(i, "{", ";", "class", "interface", "enum", "function", "import", "export"):
            i = s.close[i] + 1 if s.is_(i, "(", "[") and i in s.close else i + 1
        return i

    def function_body(i: int) -> int | None:
        """The brace of a body after the parameters at i, over a return type; None if there is none."""
        i = s.after_types(i)
        if not s.is_(i, "(") or i not in s.close:
            return None
        j = s.close[i] + 1
        if s.is_(j, ":"):
            j += 1
            while j < s.n and not s.is_(j, ";", "=>", "=", ",", "}", ")"):
                if s.is_(j, "{") and not s.is_(j - 1, ":", "|", "&", "<", ",", "=>"):
                    break
                j = s.close[j] + 1 if j in s.close else j + 1
        return j if s.is_(j, "{") else None

    def an_object(brace: int) -> bool:
        return s.is_(brace - 1, "=", "(", ",", "[", ":", "?", "return", "default", "&", "|")

    def import_clause(i: int) -> int:
        """Facts of the import statement at i; the last token of it."""
        typed = s.is_(i + 1, "type") and not s.is_(i + 2, "from", ",")
        j = i + 1 + typed
        if (spec := s.string(j)) is not None:
            fact("import", i, kind="esm", spec=spec, type_only=False)
            return j
        found: list[tuple[str, str, bool]] = []
        named_only = True
        while j < s.n and not s.is_(j, "from", ";", "import", "export", "const", "function", "class"):
            if s.is_(j, "{"):
                found += [(local, name, t) for _, name, local, t in s.braced(j)]
                j = s.close.get(j, s.n) + 1
            elif s.is_(j, "*") and s.is_(j + 1, "as"):
                found.append((s.text[j + 2], "*", False))
                named_only, j = False, j + 3
            elif s.name(j):
                found.append((s.text[j], "default", False))
                named_only, j = False, j + 1
            else:
                j += 1
        if not s.is_(j, "from") or (spec := s.string(j + 1)) is None:
            return i
        fact("import", i, kind="esm", spec=spec, type_only=typed or (named_only and bool(found) and all(t for _, _, t in found)))
        for local, name, t in found:
            bind(i, local, name, spec, typed or t)
        return j + 1

    def export_clause(i: int) -> int:
        typed = s.is_(i + 1, "type") and s.is_(i + 2, "{", "*")
        j = i + 1 + typed
        if s.is_(j, "*"):
            named = s.is_(j + 1, "as")
            at = j + 3 if named else j + 1
            if s.is_(at, "from") and (spec := s.string(at + 1)) is not None:
                fact("import", i, kind="reexport", spec=spec, type_only=typed)
                fact("export", i, s.text[j + 2] if named else "*", kind="namespace" if named else "star", imported="*", spec=spec, type_only=typed)
                return at + 1
        elif s.is_(j, "{"):
            names, end = s.braced(j), s.close.get(j, s.n)
            spec = s.string(end + 2) if s.is_(end + 1, "from") else None
            if spec is not None:
                fact("import", i, kind="reexport", spec=spec, type_only=typed or (bool(names) and all(t for *_, t in names)))
            for _, name, renamed, t in names:
                fact("export", i, renamed, kind="named" if spec is not None else "local", imported=name, spec=spec, type_only=typed or t)
                if spec is None:
                    marked.add(name)
            return end
        elif s.is_(j, "default"):
            if s.name(j + 1) and not s.is_(j + 1, "function", "class", "async", "abstract", "new", "await") and (j + 2 >= s.n or s.is_(j + 2, ";") or s.line[j + 2] > s.line[j + 1]):
                fact("export", i, "default", kind="local", imported=s.text[j + 1], type_only=False)
                marked.add(s.text[j + 1])
            elif s.is_(j + 1, "{"):
                fact("export", i, "default", kind="facade", imported="default", type_only=False)
                for _, name, local, _ in s.braced(j + 1):
                    fact("export", i, name, kind="member", imported=local, type_only=False)
                    marked.add(local)
        return i

    def required(i: int) -> None:
        """require(...) at i, with what is bound to it."""
        spec = s.string(i + 2)
        fact("import", i, kind="cjs" if spec is not None else "dynamic", spec=spec, type_only=False)
        if spec is None or not s.is_(i - 1, "="):
            return
        if s.name(i - 2) and s.is_(i - 3, "const", "let", "var", ","):
            bind(i, s.text[i - 2], "*", spec)
        elif s.is_(i - 2, "}") and i - 2 in s.open:
            for _, name, local, _ in s.braced(s.open[i - 2]):
                bind(i, local, name, spec)

    i = 0
    while i < s.n:
        if s.kind[i] != NAME:
            if s.is_(i, "<") and s.name(i + 1) and (i == 0 or s.is_(i - 1, "(", "return", "=>", "=", "?", ":", ",", "{", "}", ">", "&", "|", "[")) and (s.text[i + 1][0].isupper() or s.is_(i + 2, ".")):
                dotted = s.is_(i + 2, ".") and s.name(i + 3)
                fact("call", i, s.text[i + 3] if dotted else s.text[i + 1], kind="jsx", owner=s.text[i + 1] if dotted else None)
            i += 1
            continue
        word, outside, plain = s.text[i], s.depth[i] == 0, not s.is_(i - 1, ".", "?.")
        brace = s.braces[i]
        in_class, in_object = brace in classes, brace >= 0 and an_object(brace)
        member = brace >= 0 and s.depth[i] == s.depth[brace] + 1 and (in_class or in_object) and (s.is_(i - 1, "{", "}", ";", ",", *_MODIFIERS) or (in_class and s.line[i] > s.last[i - 1] and not s.is_(i - 1, *_CONTINUES)))
        if not plain:
            pass
        elif word == "import" and outside and not s.is_(i + 1, "(", "."):
            i = import_clause(i)
        elif word == "export" and outside:
            i = export_clause(i)
        elif word == "import" and s.is_(i + 1, "("):
            spec = s.string(i + 2) if s.is_(i + 3, ")", ",") else None
            fact("import", i, kind="dynamic", spec=spec, type_only=False)
        elif word == "require" and s.is_(i + 1, "("):
            required(i)
        elif word == "function" and s.starts(i):
            at = i + 1 + s.is_(i + 1, "*")
            if s.name(at) and (body := function_body(at + 1)) is not None:
                symbol(at, s.close.get(body, body), "function", "value", i)
                i = at
        elif word == "class" and not member:
            named = s.name(i + 1) and not s.is_(i + 1, "extends", "implements")
            body = head(i + 1)
            if s.is_(body, "{"):
                classes[body] = s.text[i + 1] if named else None
                if named and s.starts(i):
                    symbol(i + 1, s.close.get(body, body), "class", "both", i)
                at = next((k for k in range(i + 1, body) if s.is_(k, "extends")), None)
                if at is not None and s.name(at + 1) and not s.is_(at + 2, ".", "("):
                    fact("base", at, s.text[at + 1], kind="inherits")
                i += named
        elif s.typescript and word in ("interface", "enum") and s.name(i + 1) and s.starts(i) and s.is_(body := head(i + 1), "{"):
            silent.add(body)
            symbol(i + 1, s.close.get(body, body), word, "both" if word == "enum" else "type", i)
            i += 1
        elif s.typescript and word == "type" and s.name(i + 1) and s.starts(i) and s.is_(s.after_types(i + 2), "="):
            symbol(i + 1, s.ends(i + 1), "type", "type", i)
            i = s.after_types(i + 2)
        elif word in ("const", "let", "var") and outside and s.starts(i):
            at = i + 1
            while s.name(at) or s.is_(at, "{", "["):
                end = s.ends(at)
                if s.name(at) and not s.is_(at, "enum"):
                    symbol(at, end, "variable", "value", i)
                if not s.is_(end + 1, ","):
                    break
                at = end + 2
        elif member and word not in _MODIFIERS | {"constructor"} and (body := function_body(i + 1)) is not None:
            hidden = next((m for m in ("private", "protected") if any(s.is_(k, m) for k in range(max(0, i - 4), i) if s.line[k] == s.line[i])), "public")
            fact("symbol", i, word, kind="method", end_line=s.last[s.close.get(body, body)], owner=classes.get(brace), imported="value", exported=False, top=False, spec=hidden)
        elif member and word == "constructor" and (body := function_body(i + 1)) is not None:
            fact("symbol", i, word, kind="method", end_line=s.last[s.close.get(body, body)], owner=classes.get(brace), imported="value", exported=False, top=False, spec="public")
        elif s.is_(i + 1, "(") and word not in _WORDS and not s.is_(i - 1, "function", "new", "class") and not (member and in_class) and brace not in silent:
            fact("call", i, word, kind="call")
        elif s.is_(i + 1, ".", "?.") and s.name(i + 2) and s.is_(i + 3, "(") and not s.is_(i - 1, "new") and brace not in silent:
            fact("call", i, s.text[i + 2], kind="member", owner=word)
        elif word in ("module", "exports") and not s.is_(i - 1, "."):
            at = i + 1
            while s.is_(at, ".") and s.name(at + 1):
                at += 2
            whole = "".join(s.text[i:at])
            if s.is_(at, "=") and not s.is_(at + 1, "=") and (whole.startswith("exports") or whole.startswith("module.exports")):
                marked.update([s.text[at + 1]] if s.name(at + 1) and not s.is_(at + 2, "(", ".") else [n for _, n, r, _ in s.braced(at + 1) if n == r] if s.is_(at + 1, "{") else [])
        i += 1

    symbols = [r for r in out if r["fact"] == "symbol"]
    for r in symbols:
        r["exported"] = r["exported"] or (r["kind"] != "method" and r["name"] in marked)
    around = np.full((max((r["end_line"] for r in symbols), default=0)) + 2, -1)
    for k in sorted(range(len(symbols)), key=lambda k: (symbols[k]["line"], -symbols[k]["end_line"], -k)):
        around[symbols[k]["line"] : symbols[k]["end_line"] + 1] = k
    for r in out:
        if r["fact"] in ("call", "base") and r["line"] < len(around) and around[r["line"]] >= 0:
            owner = symbols[around[r["line"]]]
            r["caller"] = f"{owner['name']}@{owner['line']}"
    return out


def facts(files: DataFrame) -> DataFrame:
    """The facts of every row of (file, text); whole texts, one scan each."""

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                rows += facts_of(file or "", text)
                if len(rows) > 20000:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select("file", "text").mapInArrow(run, FACTS)


def masked(files: DataFrame) -> DataFrame:
    """The files with comments and the insides of strings blanked in `text`; lines and lengths stay."""

    def run(batches):
        for batch in batches:
            text = [None if t is None else mask(t) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, pa.string()))

    return files.mapInArrow(run, files.schema)


def is_javascript(file: Column) -> Column:
    return file.rlike(r"\.([cm]?js|jsx|tsx?)$")


_USE = "file string, name string, member string, n long"


def uses(files: DataFrame) -> DataFrame:
    """file, name, member, n: how often each name stands in code outside of import and re-export statements, and what member follows it (null: none).

    Names after a dot are members and count with what they follow; comments and the insides of strings are no code. For A29.
    """

    def run(batches):
        for batch in batches:
            out: dict[tuple, int] = {}
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                s = _Source(file or "", text or "")
                skip = _statements(s)
                for i in range(s.n):
                    if s.kind[i] == NAME and not s.is_(i - 1, ".", "?.") and i not in skip:
                        member = s.text[i + 2] if s.is_(i + 1, ".", "?.") and s.name(i + 2) else None
                        key = (file, s.text[i], member)
                        out[key] = out.get(key, 0) + 1
            columns = list(zip(*(k + (n,) for k, n in out.items()))) or [(), (), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["file", "name", "member", "n"])

    return files.select("file", "text").mapInArrow(run, _USE)


def _statements(s: _Source) -> set[int]:
    """Tokens of import statements, of re-exports, and of patterns that a require call fills."""
    out: set[int] = set()
    for i in range(s.n):
        if s.depth[i] or s.kind[i] != NAME:
            continue
        end = None
        if s.is_(i, "import") and not s.is_(i + 1, "(", "."):
            end = next((j for j in range(i, min(s.n, i + 4000)) if s.string(j) is not None or s.is_(j, ";")), None)
        elif s.is_(i, "export") and (s.is_(i + 1, "{", "*") or (s.is_(i + 1, "type") and s.is_(i + 2, "{", "*"))):
            at = i + 1 + s.is_(i + 1, "type")
            close = s.close.get(at, at)
            end = close + 2 if s.is_(close + 1, "from") else next((j for j in range(at, min(s.n, at + 5)) if s.string(j) is not None), None) if s.is_(at, "*") else None
        elif s.is_(i, "const", "let", "var") and s.is_(i + 1, "{") and i + 1 in s.close and s.is_(s.close[i + 1] + 1, "=") and s.is_(s.close[i + 1] + 2, "require"):
            end = s.close[i + 1] + 2
        if end is not None:
            out.update(range(i, end + 1))
    return out
