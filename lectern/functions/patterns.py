"""One spelling of a pattern, rendered for the JVM and for an RE2 engine.

The fixed patterns are written with the usual ``\\b`` and ``\\s``. The JVM's
``\\b`` treats accented letters as word characters and neither engine's ``\\s``
covers the no-break space, so both are spelled out when a pattern is rendered.
"""

from __future__ import annotations

WORD = "[A-Za-z0-9_]"
ASCII_BOUNDARY = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
)


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _escaped(pattern: str, i: int) -> bool:
    return (i - len(pattern[:i].rstrip("\\"))) % 2 == 1


def _alternatives(body: str) -> list[str]:
    """The parts of a pattern between the ``|`` outside its groups and classes."""
    parts, depth, in_class = [""], 0, False
    for i, ch in enumerate(body):
        plain = not _escaped(body, i)
        if plain and ch == "|" and depth == 0 and not in_class:
            parts.append("")
            continue
        if plain and (in_class or ch == "["):
            in_class = ch != "]"
        elif plain:
            depth += (ch == "(") - (ch == ")")
        parts[-1] += ch
    return parts


def _group_end(pattern: str, start: int) -> int:
    """The place of the bracket that closes the group at ``start``."""
    depth, in_class = 0, False
    for i in range(start, len(pattern)):
        ch = pattern[i]
        if _escaped(pattern, i):
            continue
        if in_class or ch == "[":
            in_class = ch != "]"
        else:
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                return i
    return len(pattern)


def _body(group: str) -> str | None:
    """What a group holds; None where it looks around or sets flags."""
    if group.startswith("?:"):
        return group[2:]
    return None if group.startswith("?") else group


def _first_letters(pattern: str) -> set[str] | None:
    """The word characters that a match must start with; None where it may start otherwise."""
    if not pattern:
        return None
    end = _group_end(pattern, 0) if pattern[0] == "(" else 0
    if pattern[end + 1 : end + 2] in tuple("?*{"):
        return None
    if _is_word(pattern[0]):
        return {pattern[0]}
    body = _body(pattern[1:end]) if pattern[0] == "(" else None
    firsts = [_first_letters(part) for part in _alternatives(body)] if body is not None else [None]
    return None if None in firsts else set().union(*firsts)


def _ends_in_word(pattern: str) -> bool:
    """Must a match end with a word character?"""
    if not pattern or _escaped(pattern, len(pattern) - 1):
        return False
    if pattern[-1] == ")":
        opened = [i for i, ch in enumerate(pattern) if ch == "(" and not _escaped(pattern, i) and _group_end(pattern, i) == len(pattern) - 1]
        body = _body(pattern[opened[0] + 1 : -1]) if opened else None
        return body is not None and all(map(_ends_in_word, _alternatives(body)))
    return _is_word(pattern[-1])


def _jvm_boundary(before: str, after: str) -> str:
    """A word boundary; one test, not two, where the pattern says which side has the word.

    The letters that may follow are tested first: most places of a text end there.
    """
    firsts = _first_letters(after)
    if firsts:
        return f"(?=[{''.join(sorted(firsts))}])(?<!{WORD})"
    # The last of several alternatives only: what stands before ``|`` does not come before this place.
    return f"(?!{WORD})" if _ends_in_word(_alternatives(before)[-1]) else ASCII_BOUNDARY


def _render(pattern: str, space: str, boundary) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(space if in_class else f"[{space}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{space}]")
            elif pair == r"\b" and not in_class:
                out.append(boundary(pattern[:i], pattern[i + 2 :]))
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def jvm(pattern: str) -> str:
    return _render(pattern, r"\s ", _jvm_boundary)


def re2(pattern: str) -> str:
    return _render(pattern, r"\s\x{00A0}", lambda before, after: r"\b")


def sql_re2(pattern: str) -> str:
    """RE2 form as a quoted SQL literal."""
    return "'" + re2(pattern).replace("'", "''") + "'"
