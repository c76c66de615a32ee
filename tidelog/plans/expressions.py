"""Expressions and search terms to columns."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.functions.values import Value, arithmetic, compare, glob_pattern, literal, number, of_column, same_value, text, truth
from tidelog.lang import search as s
from tidelog.lang.timeexpr import point
from tidelog.lang.tokens import QueryError
from tidelog.lang.tree import Between, Binary, Call, Expr, Field, Format, In, Instant, IsNull, Lit, Span, Unary
from tidelog.plans.scope import Frame, quoted

#: Characters that bound a TERM: a fixed list of the search language.
BREAKERS = " \t\n\r,;|&!?()[]{}<>\"'"


class Expressions:
    """Compiles against one frame; `now` fixes relative times."""

    def __init__(self, frame: Frame, now: datetime):
        self.frame, self.now = frame, now

    def value(self, e: Expr) -> Value:
        match e:
            case Lit(v):
                return literal(v)
            case Field(name):
                return self.frame.value(name)
            case Span(seconds):
                return Value(F.lit(float(seconds)), "span", seconds)
            case Instant(at):
                return Value(F.lit(point(at, self.now)), "time")
            case Call("now", ()):
                return Value(F.lit(self.now), "time")
            case Unary("not", of):
                return Value(~truth(self.value(of)), "bool")
            case Unary("-", of):
                v = self.value(of)
                return Value(-v.col, v.kind) if v.kind in ("int", "span") else Value(-number(v), "float")
            case Binary("and", a, b):
                return Value(truth(self.value(a)) & truth(self.value(b)), "bool")
            case Binary("or", a, b):
                return Value(truth(self.value(a)) | truth(self.value(b)), "bool")
            case Binary("??", a, b):
                return scalar.call("coalesce", [self.value(a), self.value(b)])
            case Binary("=" | "!=" | "<" | "<=" | ">" | ">=" as op, a, b):
                return Value(compare(op, self.timed(a, b), self.timed(b, a)), "bool")
            case Binary("like" | "not like" as op, a, b):
                pattern = b.value if isinstance(b, Lit) else None
                if not isinstance(pattern, str):
                    raise QueryError("like takes a quoted pattern")
                same = text(self.value(a)).ilike(pattern.replace("\\", "\\\\"))
                return Value(same if op == "like" else ~same, "bool")
            case Binary("=~" | "!~" as op, a, b):
                if not isinstance(b, Lit) or not isinstance(b.value, str):
                    raise QueryError(f"{op} takes a quoted pattern")
                found = F.coalesce(text(self.value(a)).rlike(scalar.java_regex(b.value)), F.lit(False))
                return Value(found if op == "=~" else ~found, "bool")
            case Binary(op, a, b):
                return arithmetic(op, self.value(a), self.value(b))
            case In(of, items, negated):
                return Value(self.member(self.value(of), [self.value(i) for i in items], negated), "bool")
            case Between(of, low, high):
                return Value(compare(">=", self.timed(of, low), self.timed(low, of)) & compare("<=", self.timed(of, high), self.timed(high, of)), "bool")
            case IsNull(of, negated):
                v = self.value(of)
                return Value(v.col.isNotNull() if negated else v.col.isNull(), "bool")
            case Format(parts):
                return Value(F.concat(*[F.lit(p) if isinstance(p, str) else text(self.value(p)) for p in parts] or [F.lit("")]), "str")
            case Call(name, args):
                return scalar.call(name, [self.value(a) for a in args])
        raise QueryError(f"cannot compile {e}")

    def timed(self, e: Expr, other: Expr) -> Value:
        """Spans and quoted times next to a timestamp are points in time: `_time > -1h`."""
        beside_time = isinstance(other, Field) and self.frame.value(other.name).kind == "time" or isinstance(other, Call) and other.name == "now"
        if beside_time:
            match e:
                case Unary("-", Span(seconds)):
                    return Value(F.lit(datetime.fromtimestamp(self.now.timestamp() - seconds, self.now.tzinfo)), "time")
                case Span(seconds):
                    return Value(F.lit(datetime.fromtimestamp(self.now.timestamp() + seconds, self.now.tzinfo)), "time")
                case Lit(v) if isinstance(v, str):
                    return Value(F.lit(point(v, self.now)), "time")
        return self.value(e)

    def member(self, of: Value, items: list[Value], negated: bool) -> Column:
        plain = [i for i in items if i.kind != "null"]
        if len(plain) == len(items) and plain and all(i.kind == of.kind == "str" and i.literal is not None for i in items):
            found = of.col.isin(*[i.literal for i in items])
        else:
            found = F.lit(False)
            for i in plain:
                found = found | same_value(of, i)
            if len(plain) < len(items):
                found = F.coalesce(found, F.lit(False)) | of.col.isNull()
        return ~found if negated else found

    def condition(self, e: Expr) -> Column:
        return truth(self.value(e))

    # ---- search terms: two-valued, a missing field never matches

    def search(self, t: s.Term) -> Column:
        match t:
            case s.All(of):
                return self.joined(of, lambda a, b: a & b)
            case s.Either(of):
                return self.joined(of, lambda a, b: a | b)
            case s.Not(of):
                return ~self.search(of)
            case s.Keyword():
                return F.coalesce(self.keyword(t), F.lit(False))
            case s.Comparison(field, op, value, glob):
                return F.coalesce(self.field_term(field, op, value, glob), F.lit(False))
            case s.Member(field, values):
                return self.joined([s.Comparison(field, "=", v, g) for v, g in values], lambda a, b: a | b)
        raise QueryError(f"cannot compile search term {t}")

    def joined(self, terms, op) -> Column:
        out = self.search(terms[0])
        for t in terms[1:]:
            out = op(out, self.search(t))
        return out

    def raw(self) -> Column:
        if "_raw" in self.frame.columns:
            return quoted("_raw")
        # rows without a raw line are searched as the text of their fields
        return F.concat_ws(" ", *[text(of_column(quoted(c), self.frame.type_of(c))) for c in self.frame.sortable()])

    def keyword(self, t: s.Keyword) -> Column:
        raw = self.raw()
        if t.bounded:
            edge = "[" + re.escape(BREAKERS).replace("\\ ", " ") + "]"
            return raw.rlike(rf"(?i)(^|{edge})\Q{t.text}\E($|{edge})")
        if t.exact_case:
            return raw.contains(t.text)
        if t.text == "*":
            return raw.isNotNull()
        if t.glob:
            return raw.rlike("(?i)" + glob_pattern(t.text, anchored=False))
        return F.lower(raw).contains(t.text.lower())

    def field_term(self, field: str, op: str, value: str, glob: bool) -> Column:
        v = self.frame.value(field)
        if op in ("=", "!="):
            if value == "*":
                return v.col.isNotNull() if op == "=" else F.lit(False)
            if glob:
                same = text(v).rlike("(?i)" + glob_pattern(value))
            elif v.numeric:
                same = compare("=", v, literal(value))
            else:
                same = F.lower(text(v)) == value.lower()
            return same if op == "=" else ~same
        wanted = literal(value)
        both = number(v).isNotNull() & number(wanted).isNotNull()
        lower = compare(op, Value(F.lower(text(v)), "str"), literal(value.lower()))
        return F.when(both, compare(op, Value(number(v), "float"), Value(number(wanted), "float"))).otherwise(lower)
