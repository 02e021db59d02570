"""Template source to nodes, and action text to expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Text:
    text: str
    line: int


@dataclass
class Output:
    expr: object
    line: int


@dataclass
class Assign:
    name: str
    expr: object
    declares: bool
    line: int


@dataclass
class Branch:
    """kind: if, with or range. arms: (expression or None, body, names bound by the header)."""

    kind: str
    arms: list
    line: int


@dataclass
class Define:
    name: str
    body: list
    line: int


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Field:
    """Of the dot: no parts is the dot itself."""

    parts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Variable:
    """`$` has an empty name."""

    name: str
    parts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    base: object
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = field(default_factory=tuple)


class ParseError(ValueError):
    pass


_ACTION = re.compile(r"\{\{(-(?=\s))?(\s*/\*.*?\*/\s*|(?:\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\])'|[^\"`'}]|\}(?!\}))*?)((?<=\s)-)?\}\}", re.S)


def contains_action(source: str) -> bool:
    return "{{" in source


def tokens(source: str):
    """(line, text) of literal text and (line, None, action) of actions, with the white space that actions trim taken away."""
    out, at, trim = [], 0, False
    for m in _ACTION.finditer(source):
        text = source[at : m.start()]
        if trim:
            text = text.lstrip()
        if m[1]:
            text = text.rstrip()
        if text:
            out.append((source.count("\n", 0, at) + 1, text, None))
        out.append((source.count("\n", 0, m.start()) + 1, None, m[2].strip()))
        at, trim = m.end(), bool(m[3])
    rest = source[at:].lstrip() if trim else source[at:]
    if "{{" in rest:
        raise ParseError(f"line {source.count(chr(10), 0, at + rest.index('{{')) + 1}: an action does not end")
    if rest:
        out.append((source.count("\n", 0, at) + 1, rest, None))
    return out


def parse(source: str) -> list:
    """The nodes of a template; CRLF line ends count as LF."""
    items = tokens(source.replace("\r\n", "\n"))
    nodes, at = _block(items, 0, ())
    if at < len(items):
        raise ParseError(f"line {items[at][0]}: {items[at][2]} without a block")
    return nodes


def _block(items, at, ends):
    nodes = []
    while at < len(items):
        line, text, action = items[at]
        at += 1
        if text is not None:
            nodes.append(Text(text, line))
            continue
        word = re.match(r"[a-z]*", action)[0]
        if action.startswith("/*") or action in ("break", "continue"):
            continue
        if word in ("end", "else"):
            if word not in ends:
                raise ParseError(f"line {line}: {word} without a block")
            return nodes, at - 1
        if word in ("if", "with", "range") and re.match(r"[a-z]+[\s($.]", action):
            arms, header = [], action[len(word) :]
            kind = word
            while True:
                expr, names = _header(kind, header, line)
                body, at = _block(items, at, ("end", "else"))
                arms.append((expr, body, names))
                if at >= len(items):
                    raise ParseError(f"line {line}: {word} does not end")
                tail = items[at][2]
                at += 1
                if tail == "end":
                    break
                m = re.match(r"else\s+(if|with)\b(.*)", tail, re.S)
                if m:
                    header = m[2]
                    continue
                body, at = _block(items, at, ("end",))
                arms.append((None, body, ()))
                if at >= len(items):
                    raise ParseError(f"line {line}: {word} does not end")
                at += 1
                break
            nodes.append(Branch(kind, arms, line))
        elif word in ("define", "block") and re.match(r"(define|block)\s", action):
            m = re.match(r"(?:define|block)\s+(\"(?:\\.|[^\"\\])*\"|`[^`]*`)\s*(.*)", action, re.S)
            if not m:
                raise ParseError(f"line {line}: {word} has no name")
            body, at = _block(items, at, ("end",))
            at += 1
            name = _string(m[1])
            nodes.append(Define(name, body, line))
            if word == "block":
                nodes.append(Output(Call("include", (Literal(name), expression(m[2]) if m[2] else Field())), line))
        else:
            m = re.match(r"\$(\w+)\s*(:?=)\s*(.*)", action, re.S)
            if m:
                nodes.append(Assign(m[1], expression(m[3]), m[2] == ":=", line))
            elif action:
                e = expression(action)
                nodes.append(Output(Call("include", e.args) if isinstance(e, Call) and e.name == "template" else e, line))
    if ends:
        raise ParseError("a block does not end")
    return nodes, at


def _header(kind, header, line):
    m = re.match(r"\s*\$(\w+)\s*(?:,\s*\$(\w+)\s*)?:=\s*(.*)", header, re.S)
    if m:
        return expression(m[3]), tuple(n for n in (m[1], m[2]) if n)
    return expression(header), ()


_TOKEN = re.compile(r"\s*(?:(\"(?:\\.|[^\"\\])*\"|`[^`]*`)|'((?:\\.|[^'\\]))'|(-?\d+\.\d+(?:[eE][-+]?\d+)?|-?0x[0-9a-fA-F]+|-?\d+)(?![\w.])|(\$\w*(?:\.\w+)*)|((?:\.\w+)+|\.)|([A-Za-z_]\w*)|([()|,]))")


def _string(raw: str) -> str:
    if raw.startswith("`"):
        return raw[1:-1]
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1]) or (chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else m[1]), raw[1:-1])


def expression(text: str):
    """A pipeline: what is left of | is the last argument of what is right of it."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"no expression: {text!r}")
        found.append((m, m.start(m.lastindex)))
        at = m.end()
    out, at = _pipeline(found, 0)
    if at < len(found):
        raise ParseError(f"no expression: {text!r}")
    return out


def _pipeline(found, at):
    out, at = _command(found, at)
    while at < len(found) and found[at][0][7] == "|":
        step, at = _command(found, at + 1)
        if isinstance(step, Call):
            out = Call(step.name, (*step.args, out))
        else:
            raise ParseError("a pipe leads to no function")
    return out, at


def _command(found, at):
    if at >= len(found):
        raise ParseError("an expression is missing")
    name = found[at][0][6]
    if name and name not in ("true", "false", "nil"):
        at += 1
        args = []
        while at < len(found) and found[at][0][7] not in ("|", ")", ","):
            arg, at = _operand(found, at)
            args.append(arg)
        return Call(name, tuple(args)), at
    out, at = _operand(found, at)
    args = []
    while at < len(found) and found[at][0][7] not in ("|", ")", ","):
        arg, at = _operand(found, at)
        args.append(arg)
    return (Call("call method", (out, *args)) if args else out), at


def _operand(found, at):
    m, start = found[at]
    at += 1
    if m[1] is not None:
        return Literal(_string(m[1])), at
    if m[2] is not None:
        return Literal(ord(_string('"' + m[2] + '"'))), at
    if m[3] is not None:
        return Literal(float(m[3]) if re.search(r"[.eE]", m[3]) and "x" not in m[3] else int(m[3], 0 if "x" in m[3] else 10)), at
    if m[4] is not None:
        name, *parts = m[4][1:].split(".")
        return Variable(name, tuple(parts)), at
    if m[5] is not None:
        return Field(tuple(p for p in m[5].split(".") if p)), at
    if m[6] is not None:
        return (Literal({"true": True, "false": False, "nil": None}[m[6]]) if m[6] in ("true", "false", "nil") else Call(m[6])), at
    if m[7] == "(":
        out, at = _pipeline(found, at)
        if at >= len(found) or found[at][0][7] != ")":
            raise ParseError("a parenthesis does not close")
        end = found[at][0].end()
        at += 1
        if at < len(found) and found[at][0][5] not in (None, ".") and found[at][1] == end:
            return Select(out, tuple(p for p in found[at][0][5].split(".") if p)), at + 1
        return out, at
    raise ParseError(f"unexpected {m[0].strip()!r}")


def definitions(nodes: list) -> dict[str, list]:
    """Bodies of all named blocks, those inside other blocks too; of equal names the last."""
    out: dict[str, list] = {}
    for n in nodes:
        if isinstance(n, Define):
            out[n.name] = n.body
            out |= definitions(n.body)
        elif isinstance(n, Branch):
            for _, body, _ in n.arms:
                out |= definitions(body)
    return out


def include_names(nodes: list, unconditional: bool = False) -> set[str]:
    """Literal names that the nodes include; unconditional: only those outside of branches (a branch's header always runs)."""
    out: set[str] = set()

    def of(e) -> None:
        if isinstance(e, Call):
            if e.name in ("include", "template") and e.args and isinstance(e.args[0], Literal):
                out.add(e.args[0].value)
            for a in e.args:
                of(a)
        elif isinstance(e, Select):
            of(e.base)

    for n in nodes:
        if isinstance(n, (Output, Assign)):
            of(n.expr)
        elif isinstance(n, Branch):
            for i, (e, body, _) in enumerate(n.arms):
                if e is not None and (i == 0 or not unconditional):
                    of(e)
                if not unconditional:
                    out |= include_names(body)
    return out


def include_closure(roots: set[str], bodies: dict[str, list], unconditional: bool = True) -> set[str]:
    """Names that the roots reach, themselves included, as far as there are bodies."""
    seen, rest = set(), [n for n in roots if n in bodies]
    while rest:
        name = rest.pop()
        if name not in seen:
            seen.add(name)
            rest += [n for n in include_names(bodies[name], unconditional) if n in bodies]
    return seen
