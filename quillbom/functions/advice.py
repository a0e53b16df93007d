"""What to do about an asset, and what a security level means, put together from public standards.

Facts and measures are written once, each after the standard it names; a topic lists those that
belong to it. Levels are described from the search problem that NIST compares them with.
"""

from __future__ import annotations

_FACTS = {
    "open": "Key material can be read by everyone who has the sources",
    "curves": "Discrete logarithms on curves, which quantum computers of enough size solve",
    "factors": "Integer factoring, which quantum computers of enough size solve",
    "asymmetric": "A public-key scheme from before FIPS 203 to 205",
    "collisions": "Collisions of this digest have been shown in public; SP 800-131A disallows it for signatures",
    "margin": "Category 1: the least margin that NIST compares with, that of AES-128",
    "holds": "Category 3 or above: no change is called for",
    "dated": "A certificate ends on its date, and its key with it",
    "use": "Sound in itself; what matters is how it is used",
}
_MEASURES = {
    "replace": "Count the key as compromised (SP 800-57, part 1): revoke it, make another elsewhere, and protect anew what it guarded.",
    "inject": "Let programs get keys when they run, from a key store; sources name a key and never hold it.",
    "gate": "Search commits for secrets before they are taken in: a history that is rewritten does not call back its copies.",
    "sign": "For signatures, ML-DSA (FIPS 204); SLH-DSA (FIPS 205) where size and time allow for the more cautious choice.",
    "exchange": "To establish keys, ML-KEM (FIPS 203), at first together with the present exchange, so that both would have to be broken.",
    "oldest": "Begin where secrets last longest: traffic that is recorded now may be read then.",
    "name": "Read the names of algorithms from configuration, and record them with what they protect.",
    "digest": "A digest of FIPS 180-4 or FIPS 202 with an output of 256 bits at least.",
    "redo": "What was signed or checked with the old digest is unverified until that is done anew.",
    "longer": "Keys of 256 bits for new data; encrypt old data again when it is next written.",
    "tag": "A mode that detects changes, GCM or CCM (SP 800-38D and 38C).",
    "watch": "Keep the parameter set in the inventory, so that a change of its standing can be asked for.",
    "renew": "Renewal by ACME (RFC 8555), with an alarm a month before the end.",
    "roots": "Ask issuers for their plans: roots are the last to be replaced.",
    "random": "Keys, nonces and vectors from the platform's generator (SP 800-90A).",
}
#: Topic: severity, fact, measures, and in a few words what to move to.
_TOPICS = {
    "exposed secret": ("critical", "open", ("replace", "inject", "gate"), "key store"),
    "elliptic curve": ("critical", "curves", ("sign", "exchange", "oldest"), "ML-DSA, ML-KEM"),
    "factoring": ("critical", "factors", ("exchange", "sign", "name"), "ML-KEM, ML-DSA"),
    "classical asymmetric": ("critical", "asymmetric", ("oldest", "name"), "FIPS 203 to 205"),
    "weak digest": ("high", "collisions", ("digest", "redo"), "SHA-2 or SHA-3"),
    "short key": ("medium", "margin", ("longer", "tag"), "keys of 256 bits"),
    "resistant": ("safe", "holds", ("watch",), "nothing"),
    "certificate": ("medium", "dated", ("renew", "roots"), "renewal without hands"),
    "good practice": ("low", "use", ("random",), "a sound generator"),
}
#: Topic: severity, target, summary, actions.
ADVICE: dict[str, tuple[str, str, str, list[str]]] = {
    topic: (severity, target, _FACTS[fact], [_MEASURES[m] for m in measures]) for topic, (severity, fact, measures, target) in _TOPICS.items()
}

#: Task: priority, verb, noun, rest of the title, description, fix.
TASKS: dict[str, tuple[str, str, str, str, str, str]] = {
    "exposed-secrets": ("critical", "Revoke", "key", "that the sources show", "Found in the open: {names}.", "Replace them from a key store"),
    "post-quantum": ("critical", "Schedule", "public-key asset", "for replacement", "Not of FIPS 203 to 205: {names}.", "ML-KEM beside the present exchange, then ML-DSA"),
    "weak-digests": ("high", "Retire", "use", "of broken digests", "Disallowed by SP 800-131A: {names}.", "A digest of 256 bits or more"),
    "short-keys": ("medium", "Raise", "key", "of category 1", "Least margin: {names}.", "256-bit keys in an authenticated mode"),
    "low-confidence": ("low", "Confirm", "finding", "of little evidence", "To be read by a person: {names}.", "Mark as used or unused"),
}

PLAN_TITLE = "Cryptographic work plan"
NOTHING_TO_DO = "No task is open."
#: Section of the plan: priorities in it.
SECTIONS: dict[str, list[str]] = {"Now": ["critical"], "Next": ["high"], "Planned": ["medium"], "To confirm": ["low", "info"]}

#: Security category: what it is compared with (NIST, call for proposals, 4.A.5), and parameter sets of FIPS 203 to 205 in it.
_CATEGORIES = {
    1: ("key", "AES", 128, "ML-KEM-512, SLH-DSA-SHA2-128s"), 2: ("collision", "SHA", 256, "ML-DSA-44"), 3: ("key", "AES", 192, "ML-KEM-768, ML-DSA-65, SLH-DSA-SHA2-192s"),
    4: ("collision", "SHA", 384, "no set"), 5: ("key", "AES", 256, "ML-KEM-1024, ML-DSA-87, SLH-DSA-SHA2-256s"),
}


def _category(number: int) -> tuple[str, str, str, str]:
    problem, kind, bits, sets = _CATEGORIES[number]
    steps = bits // 2 if problem == "key" else bits // 3
    span = "ten years" if number < 3 else "thirty years" if number < 5 else "longer than can be planned for"
    return (
        f"Level {number}: no easier than the {problem} search of {kind}-{bits}", f"{kind}-{bits}; of the standards: {sets}",
        f"The best quantum search known takes about 2^{steps} steps, one after another.", f"For what is to hold {span}.",
    )


#: Security level: title, algorithms, attack, recommendation.
LEVELS: dict[int, tuple[str, str, str, str]] = {
    0: ("Level 0: in no category", "Schemes on factoring and discrete logarithms, and broken ciphers and digests", "Period finding solves the problem beneath, or it is solved already.", _MEASURES["exchange"] + " " + _MEASURES["sign"]),
    **{number: _category(number) for number in _CATEGORIES},
}
