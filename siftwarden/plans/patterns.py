"""Rule patterns: dialects, required literals and the shared gate expression.

A rule is only worth running on a row that holds one of the literals its match cannot do
without.  ``required_literals`` finds them from the pattern; ``gate_pattern`` joins the
literals of a whole catalogue into one prefix-shared expression, so one pass over a row tells
which rules can match at all.  Digits are folded: the literal ``000-00-0000`` stands for any
number of that shape, so digit rules are gated like the others.  Texts and literals are folded
alike, so a literal that a match holds is found in the folded text; one with another upper-case letter than A-Z is no gate.

Limits on literal sets only make the gate weaker: a rule without usable literals runs on all rows.
"""

import re
import warnings
from functools import lru_cache
from re import _constants as K
from re import _parser as regex_parser

# Literal sets beyond this size, or runs beyond this length, do not make a better gate.
MAX_SET = 24
MAX_LENGTH = 16
MAX_CLASS = 8
# Branches tried one by one at a node of the gate expression; measured best at 8.
LEAF = 8
# Characters that the gate looks at before it tries the literals.
LEAD = 3


def _tokens(pattern):
    """Split a pattern into escapes, class brackets and single characters."""
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            yield pattern[i:i + 2], in_class
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            yield ch, False
        elif ch == "]" and in_class:
            in_class = False
            yield ch, True
        else:
            yield ch, in_class
        i += 1


# A pattern element that is one word character, and what may be repeated at its end.
_WORD_ITEM = r"(?:[A-Za-z0-9_]|\\[dw]|\[(?:0-9|a-z|A-Z|[a-f]-[a-f]|[A-Za-z0-9_])+\])"
_WORD_NEXT = re.compile(_WORD_ITEM + r"(?![?*]|\{0)")
_WORD_LAST = re.compile(r"(?<!\\)" + _WORD_ITEM + r"(?:\+|\{[1-9]\d*(?:,\d*)?\})?\Z")


def _boundary(before, after):
    """ASCII word boundary; one-sided where the neighbour in the pattern is a word character."""
    if _WORD_NEXT.match(after):
        return r"(?<!\w)"
    if _WORD_LAST.search(before) and not re.search(r"\\[^dwsbDWSB]\w*\Z", before):
        return r"(?!\w)"
    return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


# Names of the POSIX classes, as Java spells them.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct",
         "graph": "Graph", "print": "Print", "blank": "Blank", "cntrl": "Cntrl", "xdigit": "XDigit", "space": "Space"}
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_NAMED = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P?<(?![=!])\w+>")


def _common(pattern):
    """Named groups as plain ones and POSIX classes as properties, which Java and Python spell differently."""
    pattern = _NAMED.sub(r"\1(", pattern)
    return _POSIX.sub(lambda m: rf"\{'P' if m[1] else 'p'}{{{POSIX[m[2]]}}}" if m[2] in POSIX else m[0], pattern)


def _parsed(pattern):
    """Syntax tree, or None for a pattern that only the other engine reads (classes by property, flags inside)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return regex_parser.parse(_common(pattern))
    except (re.error, RecursionError, OverflowError, Warning):
        return None


def _java_error(pattern):
    """What Spark's engine says about a pattern; None if it takes it."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    session = SparkSession.getActiveSession()
    if session is None:
        return "cannot be checked without a session"
    try:
        session.range(1).select(F.lit("").rlike(to_java(pattern))).collect()
    except PySparkException as error:
        return str(error).splitlines()[0]


@lru_cache(maxsize=4096)
def to_java(pattern, unicode=False):
    """Pattern for Spark, with the line and boundary rules of the automaton dialects.

    ``(?d)`` keeps ``.`` from stopping at anything but a newline, ``$`` is the end of the
    content, and ``\\b`` is ASCII unless ``unicode`` is asked for.
    """
    pattern = _common(pattern)
    out, at = [], 0
    for token, in_class in _tokens(pattern):
        if token == "$" and not in_class:
            out.append(r"\z")
        elif token == r"\b" and not in_class and not unicode:
            out.append(_boundary(pattern[:at], pattern[at + 2:]))
        elif token == "[" and in_class:
            out.append(r"\[")
        else:
            out.append(token)
        at += len(token)
    folded = "(?u)" if not pattern.isascii() else ""
    return ("(?dU)" if unicode else "(?d)") + folded + "".join(out)


@lru_cache(maxsize=4096)
def group_probe(java):
    """(pattern, groups, probes): a Java pattern that also tells whether each of its groups took part in a match.

    The body of every group is followed by an empty group, which is set exactly if the group is.  Behind the whole
    pattern a reference to that empty group matches, and a probe then takes the character before; a reference to an
    unset group does not match, so its probe stays empty.  ``groups`` and ``probes`` are group numbers.
    """
    tokens = [t for t, _ in _tokens(java)]
    in_class = [c for _, c in _tokens(java)]
    out, stack, number, groups, marks = [], [], 0, [], []
    for i, token in enumerate(tokens):
        if token == "(" and not in_class[i]:
            rest = "".join(tokens[i + 1:i + 4])
            named = rest.startswith("?<") and rest[2:3] not in ("=", "!")
            if rest.startswith("?") and not named:
                stack.append(None)
                out.append(token)
                continue
            number += 1
            groups.append(number)
            marks.append(None)
            stack.append(len(groups) - 1)
            out.append("(" if named else "((?:")
            if named:
                raise ValueError("named groups are not probed")
        elif token == ")" and not in_class[i]:
            own = stack.pop()
            if own is None:
                out.append(token)
            else:
                number += 1
                marks[own] = number
                out.append(")())")
        elif not in_class[i] and re.fullmatch(r"\\[1-9]", token):
            out.append(f"(?:\\{groups[int(token[1:]) - 1]})")
        else:
            out.append(token)
    probes = [number + 1 + k for k in range(len(marks))]
    tests = "".join(rf"(?:(?:\{m})(?<=([\s\S]))|)" for m in marks)
    return f"(?:{''.join(out)}){tests}", tuple(groups), tuple(probes)


def to_re2(pattern):
    """The same pattern for an RE2 engine."""
    return "".join(r"\z" if t == "$" and not c else t for t, c in _tokens(pattern))


@lru_cache(maxsize=4096)
def compile_error(pattern):
    """None for a usable pattern, else why it is refused."""
    if not pattern:
        return "empty"
    tree = _parsed(pattern)
    if tree is None:
        return _java_error(pattern)
    return None if tree.getwidth()[0] else "matches the empty string"


def longest_match(pattern):
    """Upper bound of a match in characters."""
    tree = _parsed(pattern)
    return 2**32 if tree is None else tree.getwidth()[1]


# Letters that case-blind patterns take for each other: A-Z, the long s, the Kelvin sign, dotted and dotless i.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u017f\u212a\u0130\u0131"
FOLD_TO = "abcdefghijklmnopqrstuvwxyzskii"
_FOLD = str.maketrans(FOLD_FROM + "123456789", FOLD_TO + "0" * 9)


def _fold(ch):
    return ch.translate(_FOLD)


def _weight(literal):
    score = 0.0
    for ch in literal[:MAX_LENGTH]:
        if ch == " ":
            score += 0.3
        elif ch in ".,":
            score += 0.5
        elif ch.isalnum():
            score += 1.0
        else:
            score += 1.6
    return score


def _score(literals):
    """Selectivity of a literal set: its weakest member, then its size."""
    weakest = min(map(_weight, literals))
    return weakest - 0.02 * len(literals)


def _usable(literals):
    """A set worth asking for: not too many, none of them empty or a single letter."""
    return len(literals) <= MAX_SET and all(len(lit) > 1 or (lit and not lit.isalpha()) for lit in literals)


def _better(a, b):
    usable = [s for s in (a, b) if s and _usable(s)]
    return max(usable, key=_score) if usable else None


def _class_chars(items):
    chars = set()
    for op, value in items:
        if op is K.LITERAL:
            chars.add(_fold(chr(value)))
        elif op is K.RANGE and value[1] - value[0] < 10:
            chars |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
        elif op is K.CATEGORY and value is K.CATEGORY_DIGIT:
            chars.add("0")
        else:
            return None
    return chars if len(chars) <= MAX_CLASS else None


def _product(left, right):
    if left is None or right is None or len(left) * len(right) > MAX_SET:
        return None
    joined = {a + b for a in left for b in right}
    return joined if max(map(len, joined)) <= 3 * MAX_LENGTH else None


def _element(op, value):
    """(all strings the element can match or None, literals it requires or None)."""
    if op is K.LITERAL:
        exact = {_fold(chr(value))}
        return exact, exact
    if op is K.IN:
        exact = _class_chars(value)
        return exact, exact
    if op is K.AT:
        return {""}, None
    if op is K.SUBPATTERN:
        return _sequence(value[3])
    if op is K.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        exact, required = set(), set()
        for part_exact, part_required in parts:
            exact = None if exact is None or part_exact is None else exact | part_exact
            required = None if required is None or part_required is None else required | part_required
        if exact is not None and len(exact) > MAX_SET:
            exact = None
        return exact, required
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, body = value
        exact, required = _sequence(body)
        if high == 1 and low == 0:
            return (None if exact is None else exact | {""}), None
        if low == 0:
            return None, None
        repeated = {""}
        for _ in range(low):
            longer = _product(repeated, exact)
            if longer is None:
                return None, _better(required, repeated)
            repeated = longer
        return (repeated if low == high else None), _better(required, repeated)
    return None, None


def _sequence(items):
    run, run_items, best, whole = {""}, [], None, True
    for op, value in items:
        exact, required = _element(op, value)
        joined = _product(run, exact)
        if joined is not None:
            run = joined
            run_items.append((op, value))
            continue
        whole = False
        best = _better(best, run)
        if exact is None and op is K.BRANCH and run_items:
            best = _better(best, _branches(run_items, value[1]))
        if exact is None and op in (K.MAX_REPEAT, K.MIN_REPEAT) and required and _leads(value):
            # the run goes on into the first repetitions
            best = _better(best, _product(run, required))
        best = _better(best, required)
        run = exact if exact is not None else {""}
        run_items = [(op, value)] if exact is not None else []
    best = _better(best, run)
    return (run if whole else None), best


def _branches(lead, branches):
    """Literals required by an alternation whose common head has been factored out."""
    union = set()
    for branch in branches:
        _, required = _sequence(lead + list(branch))
        if required is None:
            return None
        union |= required
    return union


def _leads(repeat):
    """True when every repetition is one fixed element, so a run can be prefixed to it."""
    body = repeat[2]
    return len(body) == 1 and body[0][0] in (K.LITERAL, K.IN)


@lru_cache(maxsize=4096)
def required_literals(pattern, unicode=False):
    """Folded literals of which every match holds at least one; empty when there are none.

    Where case is ignored beyond ASCII, a literal with such a letter has other spellings, and is no gate.
    """
    tree = _parsed(pattern.replace(r"\d", r"\w") if unicode else pattern)
    best = None if tree is None else _sequence(tree)[1]
    if not best:
        return ()
    blind = re.search(r"\(\?[a-zA-Z]*i", pattern)
    if blind and not all(lit.isascii() for lit in best):
        return ()
    # the folded text holds no such letter
    if any(ch.lower() != ch for lit in best for ch in lit):
        return ()
    short = {lit[:MAX_LENGTH] for lit in best}
    # a literal that has another one as its prefix adds nothing
    return tuple(sorted(s for s in short if not any(s != o and s.startswith(o) for o in short)))


def _trie(literals):
    root = {}
    for literal in literals:
        node = root
        for ch in literal:
            node = node.setdefault(ch, {})
        node[""] = True
    return root


def _class(chars):
    return "[" + "".join("0123456789" if c == "0" else re.escape(c) for c in chars) + "]"


def _alternatives(node, chars):
    """Alternation over the next characters; a wide one first asks which half to try."""
    if len(chars) > LEAF:
        halves = chars[:len(chars) // 2], chars[len(chars) // 2:]
        return "(?:" + "|".join(f"(?={_class(h)}){_alternatives(node, h)}" for h in halves) + ")"
    branches = [("[0-9]" if c == "0" else re.escape(c)) + _emit(node[c]) for c in chars]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _emit(node):
    chars = [c for c in sorted(node) if c]
    if not chars:
        return ""
    body = _alternatives(node, chars)
    return "(?:" + body + ")?" if "" in node else body


def _lead(literals):
    """Test of up to ``LEAD`` first characters, by which most positions fail before the literals are tried."""
    by_length = {}
    for literal in literals:
        by_length.setdefault(min(len(literal), LEAD), []).append(literal)
    return "|".join("".join(_class(sorted({lit[i] for lit in same})) for i in range(length))
                    for length, same in sorted(by_length.items(), reverse=True))


def gate_pattern(literals):
    """Expression whose group 1 is the longest literal starting at a position."""
    return "(?=" + _lead(literals) + ")(?=(" + _emit(_trie(literals)) + "))"
