"""Symbolic member-access expressions ``base + index * scale + offset``.

An expression is an immutable tuple; its text is its key, so equal
expressions are one row in the table of expressions, whoever made them.
"""

from __future__ import annotations

from typing import NamedTuple


class Expr(NamedTuple):
    kind: str  # sym, const, sum, deref, ref
    sym: str = ""
    const: int = 0
    base: Expr | None = None
    idx: Expr | None = None
    scale: int = 0
    off: int = 0
    nested: Expr | None = None

    def __str__(self) -> str:
        if self.kind == "sym":
            return self.sym
        if self.kind == "const":
            return f"{'-' if self.const < 0 else ''}0x{abs(self.const):x}"
        if self.kind == "deref":
            return f"*{self.nested}"
        if self.kind == "ref":
            return f"&{self.nested}"
        parts = [str(self.base)] if self.base else []
        if self.idx:
            parts.append(f"{self.idx} * 0x{self.scale:x}")
        if self.off or not parts:
            parts.append(f"0x{self.off:x}")
        return f"({' + '.join(parts)})"


def symbol(name: str) -> Expr:
    return Expr("sym", sym=name)


def constant(value: int) -> Expr:
    return Expr("const", const=value)


def _parts(e: Expr) -> tuple[Expr | None, Expr | None, int, int]:
    if e.kind == "const":
        return None, None, 0, e.const
    if e.kind == "sum":
        return e.base, e.idx, e.scale, e.off
    return e, None, 0, 0


def add(a: Expr, b: Expr) -> Expr | None:
    """The sum; None if both have an index, or both a base."""
    (base, idx, scale, off), (base2, idx2, scale2, off2) = _parts(a), _parts(b)
    if idx and idx2:
        return None
    if base and base2:
        # Of two symbols, the second takes the place of an index of scale 1.
        if idx or idx2:
            return None
        return Expr("sum", base=base, idx=base2, scale=1, off=off + off2)
    base, idx, scale, off = base or base2, idx or idx2, scale or scale2, off + off2
    if base is None and idx is None:
        return constant(off)
    if idx is None and off == 0:
        return base
    return Expr("sum", base=base, idx=idx, scale=scale, off=off)


def multiply(a: Expr, b: Expr) -> Expr | None:
    """The product, if one side is constant."""
    if a.kind == "const":
        a, b = b, a
    if b.kind != "const":
        return None
    if a.kind == "const":
        return constant(a.const * b.const)
    if b.const == 0:
        return constant(0)
    if a.kind == "sum":
        if a.base is None and a.idx:
            return Expr("sum", idx=a.idx, scale=a.scale * b.const, off=a.off * b.const)
        return None
    return Expr("sum", idx=a, scale=b.const)


def dereference(a: Expr) -> Expr:
    if a.kind == "const" and a.const:
        raise ValueError("a constant can't be dereferenced")
    return a.nested if a.kind == "ref" else Expr("deref", nested=a)


def reference(a: Expr) -> Expr:
    return a.nested if a.kind == "deref" else Expr("ref", nested=a)


def aliases(made: Expr) -> list[tuple[Expr, Expr]]:
    """ALIAS edges that come with an expression: an indexed element stands for its base."""
    if made.kind == "sum" and made.base and made.idx and not made.off:
        return [(made, made.base)]
    if made.kind == "deref" and made.nested.kind == "sum" and made.nested.base and made.nested.idx and not made.nested.off:
        return [(made, dereference(made.nested.base))]
    return []


def root_symbol(e: Expr) -> str | None:
    while e.kind != "sym":
        e = e.nested or e.base or e.idx
        if e is None:
            return None
    return e.sym


def is_variable(e: Expr) -> bool:
    """A symbol, a symbol's reference, or what is loaded through an address."""
    return e.kind in ("sym", "deref") or e.kind == "ref" and e.nested.kind == "sym"


def field_access(e: Expr) -> tuple[Expr, int, Expr | None, int] | None:
    """(base, offset, index, scale) of a loaded field ``*(base + ...)``; None if it is none."""
    if e.kind != "deref":
        return None
    inner = e.nested
    if inner.kind == "sum":
        return (inner.base, inner.off, inner.idx, inner.scale) if inner.base else None
    return inner, 0, None, 0


def row(e: Expr, func: str) -> dict:
    """The expression's row in the table of expressions; children are named by their keys."""
    key = lambda x: str(x) if x else None
    return {"expr": str(e), "kind": e.kind, "base": key(e.base), "idx": key(e.idx), "scale": e.scale, "off": e.off, "nested": key(e.nested), "sym": e.sym or None, "const": e.const, "root_sym": root_symbol(e), "func": func}


def closure(e: Expr) -> list[Expr]:
    """The expression and all it is made of."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in (x.base, x.idx, x.nested) if c]
    return out
