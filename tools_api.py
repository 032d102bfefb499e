"""Write API.md: public functions by module with the first sentence of their docstring."""

from __future__ import annotations

import importlib
import inspect
import re
import sys

MODULES = ["covenant.sources.binding", "covenant.sources.items", "covenant.sources.store", "covenant.sources.commands",
           "covenant.sources.generate", "covenant.sources.history", "covenant.operators.lookups",
           "covenant.operators.analytics", "covenant.operators.profile", "covenant.operators.mutations",
           "covenant.operators.parity", "covenant.operators.stats", "covenant.operators.positional",
           "covenant.functions.exprs", "covenant.functions.labels", "covenant.plans.sizing",
           "covenant.plans.scenarios", "covenant.streaming.commands", "covenant.session"]


def main() -> None:
    out = ["# API index", "",
           "Public functions by module with the first sentence of their docstring. SURVEY §2 codes (S, M, A, J, W,",
           "V, T, R) lead the sentence where a function implements an inventory row. Generated by `tools_api.py`.", ""]
    for m in MODULES:
        mod = importlib.import_module(m)
        fns = [(n, f) for n, f in inspect.getmembers(mod, inspect.isfunction)
               if f.__module__ == m and not n.startswith("_")]
        if not fns:
            continue
        out += [f"## `{m}`", ""]
        for n, f in sorted(fns, key=lambda x: inspect.getsourcelines(x[1])[1]):
            para = " ".join((inspect.getdoc(f) or "").split("\n\n")[0].split())
            first = re.match(r"(.+?\.)(\s|$)", para)
            params = ", ".join(inspect.signature(f).parameters)
            out.append(f"* `{n}({params})` — {first.group(1) if first else para}")
        out.append("")
    sys.stdout.write("\n".join(out))


if __name__ == "__main__":
    main()
