"""Tiny helper that joins named CTEs into one statement, in dependency order."""
import re


def with_ctes(ctes: dict, final: str) -> str:
    needed, order = set(), []

    def visit(text):
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(ctes[name])
                order.append(name)

    visit(final)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in order) + "\n" + final


def r6(x: str) -> str:
    return f"(round(({x})::DOUBLE, 6) + 0.0)"
