"""From a question to keywords: intent, stop words, compounds and related terms. Plain Python over a handful of words."""

from __future__ import annotations

import re

#: Words that say nothing about code.
STOP_WORDS = frozenset(
    """the a an is are was were be been being have has had do does did will would could should may might can shall
    to of in for on with at by from as into through during before after above below between and but or not no nor
    so yet both either neither this that these those it its que el la los las un una de en con por para como del al""".split()
)
#: Phrases around the subject of a question.
LEADING = r"^(how does?|how do|what is|what are|where is|where are|show me|tell me|explain|find|look for|search for)\s+"
TRAILING = r"\s+(work|works|working|defined|located|implemented|used|called|handled|processed|managed)\s*\??$"
ARTICLE = r"^(the|a|an)\s+"
MOST_KEYWORDS, SHORTEST_KEYWORD, SHORTEST_PART = 10, 4, 3

#: Terms that stand for each other. More groups can be given to every function here.
GROUPS = tuple(
    tuple(line.split())
    for line in """
    login signin authenticate auth logon sso
    logout signout logoff deauthenticate
    register signup enroll onboard
    password credential secret passphrase
    token jwt bearer apikey accesstoken refreshtoken
    session cookie sessionid
    user account profile member identity
    role permission privilege access rbac acl
    authorize authz checkpermission canaccess isallowed
    create insert
    fetch retrieve lookup load
    update modify patch
    delete remove destroy purge
    findall listall getall
    save persist store write commit flush
    cache memoize buffer stash
    database db datastore repository repo storage
    migrate migration schema alembic knex
    query sql orm querybuilder
    transaction tx atomic rollback
    endpoint route handler controller action
    request payload body
    response reply
    middleware interceptor guard
    validate validation sanitize
    serialize marshal encode
    deserialize unmarshal decode
    error exception failure fault err
    throw raise panic abort
    catch handle recover rescue fallback
    retry backoff resilience circuit
    log logger logging trace debug warn
    async await promise future coroutine goroutine
    queue worker job task consumer producer
    event emit publish subscribe listener observer bus
    websocket ws socket realtime stream sse
    schedule cron timer interval periodic
    test spec
    mock stub fake fixture
    setup beforeeach beforeall bootstrap
    teardown aftereach afterall cleanup
    file directory folder
    upload attach multipart
    config configuration settings
    credential apikey
    component widget element view
    render display show draw paint
    state store redux context atom
    hook usecallback useeffect usememo usestate
    navigate route redirect push router
    modal dialog popup overlay drawer
    form input field submit validation
    gps location geolocation coordinate position latlng geo
    map marker polygon layer tile
    track tracking trace follow monitor
    notify notification alert toast message push
    email mail smtp sendgrid
    sms text twilio
    """.strip().splitlines()
)


def related(groups=GROUPS) -> dict[str, list[str]]:
    """term -> the other terms of all its groups, in order."""
    found: dict[str, dict[str, None]] = {}
    for group in groups:
        for term in group:
            found.setdefault(term, {}).update((other, None) for other in group if other != term)
    return {term: list(others) for term, others in found.items()}


def subject(task: str) -> str:
    for pattern in (LEADING, TRAILING, ARTICLE):
        task = re.sub(pattern, "", task, count=1, flags=re.I)
    return task.strip()


def keywords(task: str) -> list[str]:
    words = re.split(r"\s+", re.sub(r"[^A-Za-z0-9_\s-]", " ", subject(task).lower()))
    return [w for w in words if len(w) > 1 and w not in STOP_WORDS][:MOST_KEYWORDS]


def _styles(words: list[str]) -> list[str]:
    capital = [w[:1].upper() + w[1:] for w in words]
    return ["_".join(words), words[0] + "".join(capital[1:]), "".join(capital), "-".join(words)]


def compounds(words: list[str]) -> list[str]:
    """Identifiers that neighbouring words make, pairs and triples in the order of their first word."""
    words = [w.lower() for w in words]
    runs = [words[i : i + n] for i in range(len(words)) for n in (2, 3) if i + n <= len(words)]
    if len(words) in (3, 4):
        runs.append(words)
    return list(dict.fromkeys(style for run in runs for style in _styles(run)))


def parts_of(name: str) -> list[str]:
    """Parts of an identifier."""
    for mark in "_-":
        if mark in name:
            return [p for p in name.split(mark) if p]
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[^A-Za-z0-9]+", name)]


def expand(words: list[str], groups=GROUPS) -> list[str]:
    """Words and their related terms, and those of their parts; whatever is too short goes, words of the question too."""
    other = related(groups)
    found = dict.fromkeys(words)
    for word in map(str.lower, words):
        found.update(dict.fromkeys(other.get(word, ())))
        for part in parts_of(word):
            if len(part) >= SHORTEST_PART:
                found[part] = None
                found.update(dict.fromkeys(other.get(part, ())))
    return [w for w in found if len(w) >= SHORTEST_KEYWORD]


def question(task: str, groups=GROUPS) -> list[tuple[int, str, bool]]:
    """(position, keyword, whether it is of the question itself)."""
    words = keywords(task)
    made = compounds(words)
    own = {w.lower() for w in (*words, *made)}
    return [(i, w, w.lower() in own) for i, w in enumerate([*made, *expand(words, groups)])]
