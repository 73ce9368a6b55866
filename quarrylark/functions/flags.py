"""Flags of a command line as options of the combined filter: --name value, --name=value, switches, typed errors."""

from __future__ import annotations


def parse(words: list[str], spec: dict[str, tuple]) -> dict:
    """Options by name with _ for -; spec: name to (default, str, int or bool). What isn't known or typed is an error."""
    out, rest = {n: default for n, (default, _) in spec.items()}, iter(words)
    for word in rest:
        if not word.startswith("-"):
            raise ValueError(f"unexpected argument {word!r}")
        name, eq, value = word.lstrip("-").partition("=")
        if name not in spec:
            raise ValueError(f"no such flag: --{name}")
        kind = spec[name][1]
        if kind is bool:
            out[name] = value.lower() not in ("false", "0") if eq and value else True
            continue
        value = value or next(rest, "")
        if not value:
            raise ValueError(f"--{name} needs a value")
        try:
            out[name] = kind(value)
        except ValueError:
            raise ValueError(f"--{name} is a whole number, not {value!r}") from None
    return {n.replace("-", "_"): v for n, v in out.items()}
