"""SPARQL 1.1 SELECT and ASK: text to a tree of tuples."""

from __future__ import annotations

import re

from lectern.schema import DC, NS, RDF_TYPE, RDFS, XSD

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<str>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<var>[?$]\w+)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w.-]*\w)"""
    r"""|(?P<pname>(?:[A-Za-z][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>[A-Za-z_][\w-]*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])"""
)
PREFIXES = {"rdf": RDF_TYPE.removesuffix("type"), "rdfs": RDFS, "xsd": XSD, "dcterms": DC, "": NS, "l": NS}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def unescape(s: str) -> str:
    s = s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1]
    codes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else codes.get(m[1], m[1]), s, flags=re.S)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the query at {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.fresh, self.prefixes, self.base = 0, 0, dict(PREFIXES), ""

    # tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self) -> str:
        kind, text = self.peek()
        return text.upper() if kind == "word" else ""

    def take(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def accept(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if (kind == "op" and text in texts) or (kind == "word" and text.upper() in texts):
            self.at += 1
            return text.upper()
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise ValueError(f"expected {text} at {self.peek()[1]!r}")

    def variable(self) -> str:
        kind, text = self.take()
        if kind != "var":
            raise ValueError(f"expected a variable at {text!r}")
        return text[1:]

    def new(self) -> tuple:
        self.fresh += 1
        return ("var", f"_b{self.fresh}")

    # queries

    def query(self) -> dict:
        while w := self.accept("PREFIX", "BASE"):
            if w == "PREFIX":
                name = self.take()[1].removesuffix(":")
                self.prefixes[name] = self.take()[1][1:-1]
            else:
                self.base = self.take()[1][1:-1]
        if self.accept("ASK"):
            out = {"form": "ask"} | self.dataset()
            self.accept("WHERE")
            return out | {"where": self.group()}
        if self.word() in ("CONSTRUCT", "DESCRIBE", "INSERT", "DELETE", "LOAD", "CLEAR", "DROP", "CREATE"):
            raise ValueError(f"{self.word()} is not supported")
        out = self.select()
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return out

    def dataset(self) -> dict:
        """Graphs that FROM and FROM NAMED name."""
        out: dict = {"from": [], "named": []}
        while self.accept("FROM"):
            graph = out["named" if self.accept("NAMED") else "from"]
            kind, name = self.term()[:2]
            if kind != "iri":
                raise ValueError(f"FROM needs a graph's IRI, not {name!r}")
            graph.append(name)
        return out

    def select(self) -> dict:
        self.expect("SELECT")
        q: dict = {"form": "select", "distinct": bool(self.accept("DISTINCT", "REDUCED")), "vars": [], "group": [], "having": [], "order": [], "limit": None, "offset": 0, "values": None}
        if self.accept("*"):
            q["vars"] = None
        while q["vars"] is not None and (self.peek()[0] == "var" or self.peek()[1] == "("):
            if self.accept("("):
                e = self.expression()
                self.expect("AS")
                q["vars"].append((self.variable(), e))
                self.expect(")")
            else:
                q["vars"].append((self.variable(), None))
        q |= self.dataset()
        self.accept("WHERE")
        q["where"] = self.group()
        if self.accept("GROUP"):
            self.expect("BY")
            while self.peek()[0] == "var" or self.peek()[1] == "(" or self.call_next():
                if self.accept("("):
                    e = self.expression()
                    name = self.variable() if self.accept("AS") else self.new()[1]
                    self.expect(")")
                    q["group"].append((name, e))
                elif self.peek()[0] == "var":
                    q["group"].append((self.variable(), None))
                else:
                    q["group"].append((self.new()[1], self.primary()))
        if self.accept("HAVING"):
            while self.peek()[1] == "(" or self.call_next():
                q["having"].append(self.primary())
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                if way := self.accept("ASC", "DESC"):
                    q["order"].append((self.primary(), way == "DESC"))
                elif self.peek()[0] == "var" or self.peek()[1] == "(" or self.call_next():
                    q["order"].append((self.primary(), False))
                else:
                    break
        while w := self.accept("LIMIT", "OFFSET"):
            q[w.lower()] = int(self.take()[1])
        if self.accept("VALUES"):
            q["values"] = self.values()
        return q

    def call_next(self) -> bool:
        return self.peek()[0] in ("word", "iri", "pname") and self.peek(1)[1] == "(" and self.word() not in ("LIMIT", "OFFSET", "ORDER", "HAVING", "VALUES", "GROUP")

    # patterns

    def group(self) -> tuple:
        self.expect("{")
        if self.word() == "SELECT":
            out = ("select", self.select())
            self.expect("}")
            return out
        parts: list = []
        while not self.accept("}"):
            if self.accept("OPTIONAL"):
                parts.append(("optional", self.group()))
            elif self.accept("MINUS"):
                parts.append(("minus", self.group()))
            elif self.accept("GRAPH"):
                parts.append(("graph", self.term(), self.group()))
            elif self.accept("FILTER"):
                parts.append(("filter", self.constraint()))
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                parts.append(("bind", self.variable(), e))
                self.expect(")")
            elif self.accept("VALUES"):
                parts.append(("values", *self.values()))
            elif self.peek()[1] == "{":
                union = [self.group()]
                while self.accept("UNION"):
                    union.append(self.group())
                parts.append(("union", union) if len(union) > 1 else ("group", union[0]))
            elif self.peek()[0] == "end":
                raise ValueError("the query ends inside a group")
            else:
                triples: list = []
                self.triples(triples)
                if parts and parts[-1][0] == "bgp":
                    parts[-1][1].extend(triples)
                else:
                    parts.append(("bgp", triples))
            self.accept(".")
        return ("join", parts)

    def constraint(self) -> tuple:
        if self.word() in ("EXISTS", "NOT"):
            no = bool(self.accept("NOT"))
            self.expect("EXISTS")
            return ("exists", self.group(), no)
        return self.primary()

    def values(self) -> tuple[list, list]:
        one = self.peek()[0] == "var"
        names = []
        if one:
            names.append(self.variable())
        else:
            self.expect("(")
            while not self.accept(")"):
                names.append(self.variable())
        self.expect("{")
        rows = []
        while not self.accept("}"):
            if one:
                rows.append([None if self.accept("UNDEF") else self.term()])
            else:
                self.expect("(")
                row = []
                while not self.accept(")"):
                    row.append(None if self.accept("UNDEF") else self.term())
                rows.append(row)
        return names, rows

    def triples(self, out: list) -> None:
        subject = self.node(out)
        if self.peek()[1] in (".", "}"):
            return
        self.predicates(subject, out)

    def predicates(self, subject: tuple, out: list) -> None:
        while True:
            if self.peek()[0] == "var":
                p = ("var", self.variable())
            else:
                p = self.path()
            while True:
                out.append((subject, p, self.node(out)))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[1] in (".", "}", "]"):
                return

    def node(self, out: list) -> tuple:
        if self.accept("["):
            b = self.new()
            if not self.accept("]"):
                self.predicates(b, out)
                self.expect("]")
            return b
        return self.term()

    def path(self) -> tuple:
        left = self.sequence()
        options = [left]
        while self.accept("|"):
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self) -> tuple:
        steps = [self.step()]
        while self.accept("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else ("seq", steps)

    def step(self) -> tuple:
        if self.accept("^"):
            return ("inv", self.step())
        if self.accept("!"):
            if self.accept("("):
                no = []
                while not self.accept(")"):
                    no.append(("inv", self.term()) if self.accept("^") else self.term())
                    self.accept("|")
            else:
                no = [("inv", self.term()) if self.accept("^") else self.term()]
            out: tuple = ("not", no)
        elif self.accept("("):
            out = self.path()
            self.expect(")")
        else:
            out = self.term()
        if mark := self.accept("*", "+", "?"):
            return ("repeat", out, mark)
        return out

    def term(self) -> tuple:
        kind, text = self.take()
        if kind == "var":
            return ("var", text[1:])
        if kind == "iri":
            iri = text[1:-1]
            return ("iri", iri if ":" in iri else self.base + iri)
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return ("iri", self.prefixes[prefix] + local)
        if kind == "blank":
            return ("var", "_" + text[2:])
        if kind == "str":
            value = unescape(text)
            if self.peek()[0] == "lang":
                return ("lit", value, None, self.take()[1][1:].lower())
            if self.accept("^^"):
                return ("lit", value, self.term()[1], None)
            return ("lit", value, XSD + "string", None)
        if kind == "num" or text in ("+", "-"):
            number = text if kind == "num" else text.replace("+", "") + self.take()[1]
            return ("lit", number, XSD + ("double" if "e" in number.lower() else "decimal" if "." in number else "integer"), None)
        if kind == "word" and text == "a":
            return ("iri", RDF_TYPE)
        if kind == "word" and text.lower() in ("true", "false"):
            return ("lit", text.lower(), XSD + "boolean", None)
        raise ValueError(f"unexpected {text!r}")

    # expressions

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.accept("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.accept("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        if op := self.accept("=", "!=", "<", "<=", ">", ">="):
            return ("cmp", op, left, self.sum())
        no = False
        if self.word() == "NOT" and self.peek(1)[1].upper() == "IN":
            self.take()
            no = True
        if self.accept("IN"):
            self.expect("(")
            items = []
            while not self.accept(")"):
                items.append(self.expression())
                self.accept(",")
            return ("not", ("in", left, items)) if no else ("in", left, items)
        return left

    def sum(self) -> tuple:
        left = self.product()
        while op := self.accept("+", "-"):
            left = ("math", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while op := self.accept("*", "/"):
            left = ("math", op, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.accept("!"):
            return ("not", self.unary())
        if self.accept("-"):
            return ("math", "-", ("lit", "0", XSD + "integer", None), self.unary())
        self.accept("+")
        return self.primary()

    def primary(self) -> tuple:
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        if self.word() in ("EXISTS", "NOT"):
            return self.constraint()
        if self.peek()[0] == "word" and self.peek(1)[1] == "(":
            name = self.take()[1].upper()
            self.expect("(")
            if name in AGGREGATES:
                distinct, sep = bool(self.accept("DISTINCT")), " "
                arg = None if self.accept("*") else self.expression()
                if self.accept(";"):
                    self.expect("SEPARATOR")
                    self.expect("=")
                    sep = unescape(self.take()[1])
                self.expect(")")
                return ("agg", name, distinct, arg, sep)
            args = []
            while not self.accept(")"):
                args.append(self.expression())
                self.accept(",")
            return ("call", name, args)
        t = self.term()
        if t[0] == "iri" and self.accept("("):
            args = []
            while not self.accept(")"):
                args.append(self.expression())
                self.accept(",")
            return ("call", "CAST:" + t[1], args)
        return t


def parse(text: str) -> dict:
    return Parser(text).query()
