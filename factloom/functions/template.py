"""Templates as column expressions: parsed once, rendered for every row without leaving the JVM.

``{{ name }}``, ``{{ thing.field }}``, the filters upper, trim, truncate(n) and join("x"), ``{% for x in xs %} .. {% else %} ..
{% endfor %}``, ``{% if x %} .. {% else %} .. {% endif %}`` and ``{# remarks #}``; text between marks stays as it is.  A name
that is not given is an error when the template is built; a null is an error in the row (``strict``), or makes the row's
text null so that ``missing`` can list what was not there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

Scope = dict[str, Column]
Part = Callable[[Scope], Column]
MARK = re.compile(r"\{#.*?#\}|\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
FILTER = re.compile(r'(upper|trim|truncate\((?P<most>\d+)\)|join\("(?P<glue>[^"]*)"\))')
#: What a cut text may be longer than it should, and what stands for the rest.
LEEWAY, REST = 5, "..."


class TemplateError(ValueError):
    """A template that is not well formed, or names what is not given."""


def _truncate(c: Column, most: int) -> Column:
    head = F.substring(c, 1, most - len(REST))
    whole_words = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(c) <= most + LEEWAY, c).otherwise(F.concat(whole_words, F.lit(REST)))


def _value(said: str) -> Part:
    path, *filters = (x.strip() for x in said.split("|"))
    first, *fields = path.split(".")

    def of(scope: Scope) -> Column:
        if first not in scope:
            raise TemplateError(f"{first!r} is not given")
        out = scope[first]
        for f in fields:
            out = out.getField(f)
        for f in filters:
            found = FILTER.fullmatch(f)
            if found is None:
                raise TemplateError(f"no filter {f!r}")
            if f.startswith("join"):
                out = F.array_join(out, found["glue"])
            elif f.startswith("truncate"):
                out = _truncate(out.cast("string"), int(found["most"]))
            else:
                out = F.upper(out) if f == "upper" else strip(out.cast("string"))
        return out

    return of


def parse(template: str) -> Callable[[Scope], Column]:
    """A function from columns by name to the text."""
    tokens: list[tuple[str, str]] = []
    at = 0
    for m in MARK.finditer(template):
        tokens.append(("text", template[at : m.start()]))
        if m[1] is not None:
            tokens.append(("value", m[1]))
        elif m[2] is not None:
            tokens.append(("tag", m[2].strip()))
        at = m.end()
    tokens.append(("text", template[at:]))
    tokens.reverse()

    def block(*ends: str) -> tuple[Part, str]:
        parts: list[Part] = []
        while tokens:
            kind, said = tokens.pop()
            if kind == "text":
                if said:
                    parts.append(lambda scope, said=said: F.lit(said))
            elif kind == "value":
                parts.append(lambda scope, of=_value(said): of(scope).cast("string"))
            elif said in ends:
                return lambda scope: F.concat(F.lit(""), *(p(scope) for p in parts)), said
            else:
                parts.append(tag(said))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return lambda scope: F.concat(F.lit(""), *(p(scope) for p in parts)), ""

    def tag(said: str) -> Part:
        loop, test = re.fullmatch(r"for (\w+) in ([\w.]+)", said), re.fullmatch(r"if ([\w.]+)", said)
        if loop is None and test is None:
            raise TemplateError(f"no tag {said!r}")
        end = "endfor" if loop else "endif"
        body, stop = block("else", end)
        other: Part = lambda scope: F.lit("")
        if stop == "else":
            other, _ = block(end)
        things = _value((loop or test)[2 if loop else 1])

        def build(scope: Scope) -> Column:
            xs = things(scope)
            if loop:
                each = F.array_join(F.transform(xs, lambda x: body(scope | {loop[1]: x})), "")
                return F.when(F.size(xs) > 0, each).otherwise(other(scope))
            return F.when(F.coalesce(F.length(xs.cast("string")) > 0, F.lit(False)) & ~xs.cast("string").isin("[]", "false", "0"), body(scope)).otherwise(other(scope))

        return build

    return block()[0]


def render(template: str, given: Scope, strict: bool = True) -> Column:
    """The text of a template for every row."""
    out = parse(template)(given)
    nulls = missing(given)
    said = F.raise_error(F.concat(F.lit("not given: "), F.array_join(nulls, ", "))).cast("string")
    return F.when(F.size(nulls) == 0, out).otherwise(said if strict else F.lit(None).cast("string"))


def missing(given: Scope) -> Column:
    """Names whose value is null in a row, in order."""
    return F.array_compact(F.array(*(F.when(given[n].isNull(), F.lit(n)) for n in sorted(given))))
