"""The macro layer: text to text, on the driver.

One scan from left to right; variables are resolved and macros called as they are met, so their order is that of the
program. Text that a macro makes is scanned again in its place.
"""

from __future__ import annotations

import datetime as dt
import re

from .lexer import ProgramError

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Scope(dict):
    """Variables by upper-case name."""


class Macro:
    def __init__(self, name, params, body):
        self.name, self.params, self.body = name, params, body


class _Return(Exception):
    pass


class _Goto(Exception):
    def __init__(self, label):
        self.label = label


class MacroProcessor:
    """``sysfunc`` evaluates a function by name; ``log`` takes (kind, text)."""

    def __init__(self, sysfunc=None, log=lambda kind, text: None, now=None):
        now = now or dt.datetime.now()
        self.globals = Scope(
            SYSDATE=now.strftime("%d%b%y").upper(), SYSDATE9=now.strftime("%d%b%Y").upper(), SYSTIME=now.strftime("%H:%M"), SYSDAY=now.strftime("%A"), SYSVER="9.4", SYSERR="0", SYSSCP="LIN X64", SYSLAST="_NULL_"
        )
        self.scopes: list[Scope] = [self.globals]
        self.macros: dict[str, Macro] = {}
        self.sysfunc, self.log = sysfunc, log
        self.depth = 0
        self.streaming, self.buffer, self.on_step = False, [], None

    # variables

    def get(self, name: str) -> str | None:
        for s in reversed(self.scopes):
            if name.upper() in s:
                return s[name.upper()]
        return None

    def set(self, name: str, value: str) -> None:
        for s in reversed(self.scopes):
            if name.upper() in s:
                s[name.upper()] = value
                return
        self.scopes[-1][name.upper()] = value

    def set_global(self, name: str, value: str) -> None:
        for s in reversed(self.scopes):
            if name.upper() in s:
                s[name.upper()] = value
                return
        self.globals[name.upper()] = value

    def resolve(self, text: str) -> str:
        """Replaces &name, &&name&i and &name. until nothing changes."""
        for _ in range(50):
            done = re.sub(r"&&|&([A-Za-z_][A-Za-z0-9_]*)\.?", lambda m: "&" if m[0] == "&&" else m[0] if (v := self.get(m[1])) is None else v, text)
            if done == text:
                return text
            text = done
        raise ProgramError("macro variables refer to each other without an end")

    # scanning

    def expand(self, text: str) -> str:
        self.depth += 1
        if self.depth > 60:
            raise ProgramError("macros call each other without an end")
        before, self.streaming = self.streaming, False
        try:
            return self._scan(text)
        finally:
            self.depth -= 1
            self.streaming = before

    def stream(self, text: str, on_step) -> None:
        """Expands a program and hands over its text whenever a step ends, so that what a step sets is known to the text behind it."""
        self.buffer, self.on_step, self.streaming = [], on_step, True
        try:
            self._scan(text)
            self._flush()
        finally:
            self.streaming = False

    def _flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer.clear()
        if text.strip():
            self.streaming = False
            try:
                self.on_step(text)
            finally:
                self.streaming = True

    def _inner(self, text: str) -> str:
        """Text that takes the place of a macro statement: on to the program's buffer, or given back."""
        if not self.streaming:
            return self.expand(text)
        self.depth += 1
        if self.depth > 60:
            raise ProgramError("macros call each other without an end")
        try:
            self._scan(text)
            return ""
        finally:
            self.depth -= 1

    def _scan(self, text: str) -> str:
        out: list[str] = self.buffer if self.streaming else []
        at = 0
        while at < len(text):
            c = text[at]
            if c == "'":
                end = text.find("'", at + 1)
                end = len(text) if end < 0 else end + 1
                out.append(text[at:end])
                at = end
            elif text.startswith("/*", at):
                end = text.find("*/", at + 2)
                at = len(text) if end < 0 else end + 2
            elif text.startswith("%*", at):
                end = text.find(";", at)
                at = len(text) if end < 0 else end + 1
            elif c == '"':
                end = at + 1
                while end < len(text) and text[end] != '"':
                    end += 1
                inner = text[at + 1 : end]
                out.append('"' + (self.expand(inner) if "%" in inner and re.search(r"%[A-Za-z_]", inner) and self._known_call(inner) else self.resolve(inner)) + '"')
                at = end + 1
            elif c == "&" and (m := re.compile(r"&+[A-Za-z_][A-Za-z0-9_]*(?:\.|(?:&+[A-Za-z_][A-Za-z0-9_]*\.?)*)").match(text, at)):
                value = self.resolve(m[0])
                if value == m[0]:
                    out.append(value)
                elif "%" in value or "&" in value:
                    out.append(self.expand(value))
                else:
                    out.append(value)
                at = m.end()
            elif c == "%" and (m := _NAME.match(text, at + 1)):
                made, at = self._percent(m[0].lower(), text, m.end(), out)
                out.append(made)
            else:
                out.append(c)
                at += 1
                if c == ";" and self.streaming and re.search(r"(?:^|[\s;])(run|quit)\s*;$", "".join(out[-12:]), re.I):
                    self._flush()
        return "" if out is self.buffer else "".join(out)

    def _known_call(self, text: str) -> bool:
        return any(m.lower() in self.macros or m.lower() in _FUNCTIONS for m in re.findall(r"%([A-Za-z_][A-Za-z0-9_]*)", text))

    def _statement(self, text: str, at: int) -> tuple[str, int]:
        """Up to the next semicolon outside of quotes and parentheses."""
        depth, i, quote = 0, at, ""
        while i < len(text):
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == ";" and depth <= 0:
                return text[at:i], i + 1
            i += 1
        return text[at:], len(text)

    def _parens(self, text: str, at: int) -> tuple[str, int] | None:
        """The inside of parentheses at ``at`` (after blanks), and where they end."""
        m = re.compile(r"\s*\(").match(text, at)
        if not m:
            return None
        depth, i, quote = 1, m.end(), ""
        while i < len(text):
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "%" and i + 1 < len(text) and text[i + 1] in "()'\"":
                i += 1
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if not depth:
                    return text[m.end() : i], i + 1
            i += 1
        raise ProgramError("a parenthesis is not closed")

    @staticmethod
    def split(text: str, by: str = ",") -> list[str]:
        parts, depth, now, quote = [], 0, "", ""
        for c in text:
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            if c == by and not depth and not quote:
                parts.append(now)
                now = ""
            else:
                now += c
        return [*parts, now]

    def _block(self, text: str, at: int, begin: str, end: str) -> tuple[str, int]:
        """Text up to the %end that belongs to a %begin before ``at``."""
        depth = 1
        for m in re.compile(rf"/\*.*?\*/|%({begin}|{end})\b", re.I | re.S).finditer(text, at):
            if not m[1]:
                continue
            depth += 1 if m[1].lower() == begin else -1
            if not depth:
                return text[at : m.start()], m.end()
        raise ProgramError(f"%{begin.upper()} without %{end.upper()}")

    def _percent(self, word: str, text: str, at: int, out: list[str]) -> tuple[str, int]:
        if word == "let":
            body, at = self._statement(text, at)
            name, _, value = body.partition("=")
            self.set(self.expand(name).strip(), self.expand(value).strip())
            return "", at
        if word == "macro":
            head, at = self._statement(text, at)
            body, at = self._block(text, at, "macro", "mend")
            _, at = self._statement(text, at)
            m = re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\((.*?)\))?\s*(?:/.*)?$", head, re.S)
            if not m:
                raise ProgramError(f"%MACRO {head.strip()}")
            params = []
            for p in self.split(m[2] or ""):
                if p.strip():
                    n, eq, d = p.partition("=")
                    params.append((n.strip().upper(), d.strip() if eq else None, bool(eq)))
            self.macros[m[1].lower()] = Macro(m[1].lower(), params, body)
            return "", at
        if word in ("global", "local"):
            body, at = self._statement(text, at)
            for n in self.expand(body).split():
                if word == "global":
                    self.globals.setdefault(n.upper(), "")
                else:
                    self.scopes[-1].setdefault(n.upper(), "")
            return "", at
        if word == "put":
            body, at = self._statement(text, at)
            body = self.expand(body).strip()
            listed = {"_all_": [s for s in self.scopes], "_user_": self.scopes, "_automatic_": [self.globals], "_global_": [self.globals], "_local_": self.scopes[-1:]}.get(body.lower())
            if listed is not None:
                auto = {k for k in self.globals if k.startswith("SYS")}
                for s in listed:
                    for k, v in sorted(s.items()):
                        if (k in auto) == (body.lower() == "_automatic_") or body.lower() in ("_all_", "_global_"):
                            self.log("put", f"{'GLOBAL' if s is self.globals else 'LOCAL'} {k} {v}")
            else:
                self.log("put", body)
            return "", at
        if word == "if":
            return self._if(text, at)
        if word == "do":
            return self._do(text, at)
        if word == "return":
            raise _Return
        if word == "goto":
            body, at = self._statement(text, at)
            raise _Goto(self.expand(body).strip().lower())
        if word in ("abort", "symdel", "sysexec", "syscall", "include", "inc"):
            body, at = self._statement(text, at)
            if word == "symdel":
                for n in self.expand(body).split():
                    self.globals.pop(n.upper(), None)
            return "", at
        if word in _FUNCTIONS and (found := self._parens(text, at)):
            return _FUNCTIONS[word](self, found[0]), found[1]
        if word in self.macros:
            return self._invoke(self.macros[word], text, at)
        m = re.compile(r"\s*:").match(text, at)
        if m:  # a label
            return "", m.end()
        return "%" + text[at - len(word) : at], at

    def _if(self, text: str, at: int) -> tuple[str, int]:
        m = re.compile(r"%then\b", re.I).search(text, at)
        if not m:
            raise ProgramError("%IF without %THEN")
        cond = truth(self.evaluate(self.expand(text[at : m.start()])))
        yes, at = self._branch(text, m.end())
        no, here = None, at
        m = re.compile(r"(?:\s|/\*.*?\*/)*%else\b", re.I | re.S).match(text, at)
        if m:
            no, here = self._branch(text, m.end())
        chosen = yes if cond else no
        return (self._inner(chosen) if chosen else ""), here

    def _branch(self, text: str, at: int) -> tuple[str, int]:
        m = re.compile(r"\s*%do\s*;", re.I).match(text, at)
        if m:
            body, end = self._block(text, m.end(), "do", "end")
            _, end = self._statement(text, end)
            return body, end
        m = re.compile(r"\s*%if\b", re.I).match(text, at)
        if m:  # a nested %IF with its own %ELSE
            then = re.compile(r"%then\b", re.I).search(text, m.end())
            _, end = self._branch(text, then.end())
            e = re.compile(r"\s*%else\b", re.I).match(text, end)
            if e:
                _, end = self._branch(text, e.end())
            return text[at:end], end
        m = re.compile(r"\s*%do\b", re.I).match(text, at)
        if m:
            _, after = self._statement(text, m.end())
            _, end = self._block(text, after, "do", "end")
            _, end = self._statement(text, end)
            return text[at:end], end
        body, end = self._statement(text, at)
        body = body.lstrip()
        return (body + ";" if re.match(r"%(let|put|return|goto|global|local|abort)\b", body, re.I) else body + ";" if not body.startswith("%") or body[1:].split("(")[0].strip().lower() not in self.macros else body), end

    def _do(self, text: str, at: int) -> tuple[str, int]:
        head, at = self._statement(text, at)
        body, at = self._block(text, at, "do", "end")
        _, at = self._statement(text, at)
        out = []
        m = re.fullmatch(r"\s*(\S+?)\s*=\s*(.*?)%to\b(.*?)(?:%by\b(.*))?", head, re.I | re.S)
        w = re.fullmatch(r"\s*%(while|until)\s*\((.*)\)\s*", head, re.I | re.S)
        if m:
            var = self.expand(m[1]).strip()
            x, z, by = (int(float(self.evaluate(self.expand(t)))) if t else 1 for t in (m[2], m[3], m[4]))
            while x <= z if by > 0 else x >= z:
                self.set(var, str(x))
                out.append(self._inner(body))
                x = int(float(self.get(var))) + by
            self.set(var, str(x))
        elif w:
            for _ in range(100_000):
                if w[1].lower() == "while" and not truth(self.evaluate(self.expand(w[2]))):
                    break
                out.append(self._inner(body))
                if w[1].lower() == "until" and truth(self.evaluate(self.expand(w[2]))):
                    break
        elif not head.strip():
            out.append(self._inner(body))
        else:
            raise ProgramError(f"%DO {head.strip()}")
        return "".join(out), at

    def _invoke(self, macro: Macro, text: str, at: int) -> tuple[str, int]:
        found = self._parens(text, at) if macro.params or re.compile(r"\s*\(\s*\)").match(text, at) else None
        args, at = (self.split(found[0]), found[1]) if found else ([], at)
        local = Scope({n: self.expand(d) if d else "" for n, d, _ in macro.params})
        positional = [n for n, _, _ in macro.params]
        k = 0
        for a in args:
            m = re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*=", a)
            if m and m[1].upper() in local:
                local[m[1].upper()] = self.expand(a[m.end() :]).strip()
            elif a.strip() or len(args) > 1:
                if k >= len(positional):
                    raise ProgramError(f"%{macro.name.upper()} has {len(positional)} parameters")
                local[positional[k]] = self.expand(a).strip()
                k += 1
        m = re.compile(r"[ \t]*;").match(text, at)
        if m:  # the semicolon behind a call is part of it
            at = m.end()
        self.scopes.append(local)
        try:
            body, out = macro.body, ""
            while True:
                try:
                    out += self._inner(body)
                    break
                except _Return:
                    break
                except _Goto as g:
                    label = re.search(rf"%{g.label}\s*:", macro.body, re.I)
                    if not label:
                        raise ProgramError(f"no label {g.label}") from None
                    body = macro.body[label.end() :]
            return out, at
        finally:
            self.scopes.pop()

    def evaluate(self, text: str, floats: bool = False) -> str:
        return Evaluator(text, floats).run()


def truth(text: str) -> bool:
    try:
        return float(text) != 0
    except ValueError:
        return bool(text.strip())


class Evaluator:
    """%EVAL and %SYSEVALF, with the precedence of the language."""

    TOKEN = re.compile(r"\s*(\*\*|<=|>=|\^=|~=|<>|\|\||[-+*/<>=()&|^~#]|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|'[^']*'|\"[^\"]*\"|[^\s\-+*/<>=()&|^~#]+)")
    WORDS = {"eq": "=", "ne": "^=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "and": "&", "or": "|", "not": "^", "~=": "^=", "<>": "^=", "~": "^"}

    def __init__(self, text: str, floats: bool):
        self.text, self.floats = text, floats
        self.tokens = [self.WORDS.get(t.lower(), t) for t in self.TOKEN.findall(text)]
        self.i = 0

    def run(self) -> str:
        if not self.tokens:
            return "0" if not self.text.strip() and False else ""
        v = self._or()
        if self.i < len(self.tokens):
            return self.text.strip()
        return self._show(v)

    def _show(self, v) -> str:
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
        return str(v)

    def _peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def _or(self):
        v = self._and()
        while self._peek() == "|":
            self.i += 1
            w = self._and()
            v = int(truth(str(v)) or truth(str(w)))
        return v

    def _and(self):
        v = self._cmp()
        while self._peek() == "&":
            self.i += 1
            w = self._cmp()
            v = int(truth(str(v)) and truth(str(w)))
        return v

    def _cmp(self):
        if self._peek() == "^":
            self.i += 1
            return int(not truth(str(self._cmp())))
        v = self._add() if self._peek() not in ("=", "^=", "<", "<=", ">", ">=") else ""
        while self._peek() in ("=", "^=", "<", "<=", ">", ">="):
            op = self.tokens[self.i]
            self.i += 1
            w = self._add() if self._peek() not in (None, "&", "|", ")") else ""
            a, b = self._num(v), self._num(w)
            if a is None or b is None:
                a, b = str(v), str(w)
            v = int({"=": a == b, "^=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        return v

    @staticmethod
    def _num(v):
        try:
            return float(v)
        except ValueError:
            return None

    def _both(self, a, b, op):
        x, y = self._num(a), self._num(b)
        if x is None or y is None:
            raise ProgramError(f"a number is needed in {self.text.strip()!r}")
        if op == "/" and y == 0:
            raise ProgramError("division by zero in a macro expression")
        r = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "**": lambda: x**y}[op]()
        return r if self.floats else int(r)

    def _add(self):
        v = self._mul()
        while self._peek() in ("+", "-"):
            op = self.tokens[self.i]
            self.i += 1
            v = self._both(v, self._mul(), op)
        return v

    def _mul(self):
        v = self._unary()
        while self._peek() in ("*", "/"):
            op = self.tokens[self.i]
            self.i += 1
            v = self._both(v, self._unary(), op)
        return v

    def _unary(self):
        if self._peek() == "-":
            self.i += 1
            v = self._num(self._unary())
            return -v if v is not None and self.floats else -int(v or 0)
        if self._peek() == "+":
            self.i += 1
            return self._unary()
        v = self._primary()
        if self._peek() == "**":
            self.i += 1
            v = self._both(v, self._unary(), "**")
        return v

    def _primary(self):
        t = self._peek()
        if t is None:
            return ""
        self.i += 1
        if t == "(":
            v = self._or()
            if self._peek() == ")":
                self.i += 1
            return v
        return t


def _quoted(p: MacroProcessor, body: str) -> str:
    return re.sub(r"%([()'\"%])", r"\1", p.expand(body))


def _scan(p, body):
    a = [p.expand(x) for x in p.split(body)]
    delims = a[2].strip("'\"") if len(a) > 2 and a[2] else " .<(+&!$*);^-/,%|"
    parts = [x for x in re.split("[" + re.escape(delims) + "]+", a[0].strip()) if x]
    n = int(float(p.evaluate(a[1])))
    return parts[n - 1] if 0 < n <= len(parts) else parts[n] if n < 0 and -n <= len(parts) else ""


def _substr(p, body):
    a = [p.expand(x) for x in p.split(body)]
    at = int(float(p.evaluate(a[1])))
    n = int(float(p.evaluate(a[2]))) if len(a) > 2 and a[2].strip() else None
    return a[0][at - 1 :][:n]


def _sysfunc(p, body):
    m = re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*", body)
    found = p._parens(body, m.end())
    if p.sysfunc is None or found is None:
        raise ProgramError(f"%SYSFUNC({body})")
    args = [p.expand(x).strip() for x in p.split(found[0])] if found[0].strip() else []
    rest = body[found[1] :].lstrip(" ,").strip()
    return p.sysfunc(m[1].lower(), args, rest or None)


_FUNCTIONS = {
    "upcase": lambda p, b: p.expand(b).upper(),
    "lowcase": lambda p, b: p.expand(b).lower(),
    "length": lambda p, b: str(len(p.expand(b).strip()) or 1),
    "index": lambda p, b: str((x := [p.expand(y) for y in p.split(b)])[0].find(x[1].strip()) + 1),
    "scan": _scan,
    "qscan": _scan,
    "substr": _substr,
    "qsubstr": _substr,
    "eval": lambda p, b: p.evaluate(p.expand(b)),
    "sysevalf": lambda p, b: (lambda v, kind: str(int(truth(v))) if kind == "boolean" else str(int(float(v) // 1)) if kind in ("integer", "floor") else str(-int(-float(v) // 1)) if kind == "ceil" else v)(p.evaluate(p.expand(p.split(b)[0]), True), (p.split(b)[1].strip().lower() if len(p.split(b)) > 1 else "")),
    "str": _quoted,
    "nrstr": lambda p, b: re.sub(r"%([()'\"%])", r"\1", b),
    "quote": _quoted,
    "bquote": _quoted,
    "nrbquote": _quoted,
    "superq": lambda p, b: p.get(p.expand(b).strip()) or "",
    "unquote": lambda p, b: p.expand(b),
    "symexist": lambda p, b: str(int(p.get(p.expand(b).strip()) is not None)),
    "sysfunc": _sysfunc,
    "qsysfunc": _sysfunc,
    "trim": lambda p, b: p.expand(b).rstrip(),
    "left": lambda p, b: p.expand(b).lstrip(),
}
