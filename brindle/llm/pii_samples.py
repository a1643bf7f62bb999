"""Labelled sample for the personal-information model, made from invented parts by a seeded rule."""

from __future__ import annotations

import random

from brindle.llm.pii_model import ADDRESS, DIGITS, EMAIL, FIRST, ID, LAST, NAME, NUMBERS, PHONE

# Invented carrier sentences; {n} a name, {s} a single name, {l} a last name, {e} e-mail, {p} phone, {i} identity number, {a} address;
# {c} company, {t} short code, {r} code shaped like an identity number, {v} version, {k} grouped number, {x} long number, {d} date, {y} number, {o} role of a speaker.
CARRIERS = """
Hi {s}, the oven is warm.|Hello {s}|Hi {s},|Hey {n}, nice garden!|Dear {n},|Dear {s},|Thanks {s}.|Thank you, {s}.|Cheers {s}, see you at the lake.|Lovely idea, {s}.|Well spotted, {s}. The lamp flickers.|{s}, bring the ladder over.|{s}, do you have the keys?|Yes {s}, both of them.|No, {s}, the other one.|Right, {s}?|Sorry {s} - my train is late.|Oh, {s}, one more thing.|So {s} fed the cat.|And {s} painted it.
We met {n} near the harbour.|Yesterday I phoned {n} about the roof.|My cousin {n} bakes bread.|My neighbour {n} heard it first.|Our gardener {n} waters them.|Kindly copy {n}.|Invite {n} as well.|Like {n} told us on Sunday.|If we trust {n}, it rained.|Check with {n} about the paint.|Let {n} know about the tiles.|Our plumber is {n}.|The tenant is {n}.|The baker, {n}, was away.|{n} of the bakery nodded.|{n} from accounts smiled.|{n} came late.|{n} will paint it.|{n} has the spare key.|Does {n} still own a boat?|Give it to {n} or {n}.|Neither {n} nor {n} won.|I saw {n}'s bicycle.|That was {s}'s umbrella.|Only {s} and {s} were at home.|{s} and I carried the sofa.|Was that {s} or {s}?|They confide in {n}.|They confide in {s}.|Who brought in {n}?|Bring in {s}. We boil water.|Pull in {n}.|Pull in Dr. {n}.|Count {n} in.|A poem of {n}, on {s}.|Sail with {s}. It is calm.|A song for {n} by {n}.|Nobody but {s} swam.|It was up to {n}.|Mr {l} and Ms {l} swam.|My aunt Mr {l} knows.|The cook is Ms {l}.|I wrote to Mr {l} again.|I wrote to Dr. {l} again.|{n} ({c}) brought cake.
{n}: The kettle boils.|**{n}:** Nobody waits.|**{n}**: Fine by me.|[{n}] It snows again.|[{n}]: It snows again.|<{n}> It snows again.|>> {n}: Say that once more?|> {n}: no idea|{n} - Perhaps tomorrow.|[{n}, {o} @ 03:12] Nothing in the shed.|[{n}, {o} @ 00:00] {n}: Sure.|[{n} ({c}), {o} @ 01:02:03] Sure.|[{n} [Visitor], {o} @ 01:31] Sure.|[{n} - {o}, {o} @ 01:31] Sure.|[{n} | tablet, {o} @ 11:31] Sure.|[{n} (he/him), {o} @ 11:31] Sure.|[{n}, {o} @ 00:00]|[{n}, {o} @ 00:00]
guests: {n} [{o}], {n} [{o}], {n} [{o}]|guests: {n} [{o}], {n} [{o}]|**{n} ({c})** - {d} 10:20|**{n} ({c})** - {d} 23:05|Thx, {n}|Best, {n}|Yours, {n}|{n}|{n}|{n}.|{s}|{s} -|{s} (|By {n}, {d}|from: {n}|to: {n}|cc: {n}; {n}|Dr. {n} nodded.|We asked Prof. {n} about moss.|Mr {l} sneezed twice.|Ms. {l} sneezed twice.|Mrs {l}, sit down.|M. {l} sneezed twice.|Herr {l} sneezed.|Have you met Dr. {n}?|Say hi to Dr {l}.
Post it to {e}.|Mine is {e}.|Cc {e} too.|Sign up under {e}.|Forward the recipe to {e}.|A leaflet went to {e}.|{e}|Mail: {e}|mailto: {e}|Ask at {e} for a map.|From {e}, no doubt.|Either {e} or {e}.|({e})|<{e}>|It bounced from {e}, again.
Ring me under {p}.|My cell is {p}.|Mobile: {p}|Tel {p}|Tel. {p}.|Tel: {p}|phone {p}|Phone: {p}|P: {p}|T: {p}|M: {p}|Reach the bakery at {p}.|Text {p} if the bus is late.|Text me at {p}.|Call {p} now.|Call him at {p}.|Call her on {p} after dusk.|Dial {p} and wait.|Our callback number is {p}.|The new number is {p}, same as his phone.|The phone number {p} is hers.|Use my mobile number, {p}.|Leave a message at {p}.|WhatsApp {p}|fax {p}|Number {p} still rings.|Is {p} still his number?|{p}|You can reach me on {p}.|Best phone is {p}.|Line {p} rings out.
Passport: {i}.|Her passport number is {i}.|His passport, {i}, is torn.|Passport no. {i}|The ID card says {i}.|The national ID says {i}.|National ID: {i}|Her identity card number is {i}.|For the identity proof take {i}.|Identity number {i}|identification number {i}|The driving licence {i} has lapsed.|Driver licence: {i}, scanned.|Driver's license no. {i}|The licence number is {i}.|Her tax number, {i}, was smudged.|Tax ID {i}|Tax id: {i}|The taxpayer number is {i}.|Social security: {i}|A social security number, {i}, stood there.|SSN {i}|SSN: {i}|(personal-ID {i})|(ID: {i}).|Personal number {i}|Insurance number {i} is smudged.|The national insurance number is {i}.|Health card {i}|Residence permit {i}|Verify me by {i} on the licence form.|My ID is {i}, on page two.|Her ID number is {i}.|The ID number on paper reads {i}.|The passport on file reads {i}.|The one on the tax paper reads {i}.
Come to {a}.|We live at {a}.|I moved to {a}.|Bring the chairs to {a}.|A parcel for {a}.|The bill goes to {a}.|Our workshop is at {a}.|The studio at {a} is closed.|{c}, {a}|{a}|Address: {a}|Deliver to {a} please.|Meet us at {a} after lunch.|His flat is {a}.|I think it is {a} there.|They left {a} in spring.|Send flowers to {a}, and wine.
Our locker is {t} and the request number was {r}.|Request: {r} came back.|One request id, {r}, timed out.|request-id {r}|Request ID: {r}|Case {r} is shut.|Ticket no. {r}|Ticket {t} is new, request {r}.|The log shows build {v} of the kettle app.|Quieter in version {v}.|It began at 04:06 and counted {k} apples in a row.|Port 8443 and build {v} gave code 116.|X-Trace: {x}|trace {x}|date: {d}|client: {c}|**{n} ({c})** - {d} 16:59|[tags: a, b] {d}|{d} 07:12 awake|On {d} it cracked.|{d}|ts={y};lvl=W;ms={y}|Row {y} is empty.|row {y} of {y}|Order {y} is overdue.|Order number {y}|Build {y} is out.|build number {y}|The jar weighs {y} grams.|It counted {y} bytes.|id {y}|id={y}|code: {y}|code {r}|see {r} for more|see row {r}|The trace number {x} is in the book.|Page 12 of {d}.|Batch {r} failed.|Session: {r} ended.|Serial {r}|Record {y} was skipped.|event {y}|Reference {r}|Job {y} done after {k} rows.|Invoice no. {r}, paid.|Version: {v}|v{v}|at 12:30:45 with 4,096 rows|on {d} at 07:12:44|Export {y} took {k} ms.|error {y}|uuid {x}
Mark my spot, the queue moves.|[{n}, {o} @ 03:12] Mark my chair, I am back soon.|<{s}> Mark my chair.|Mark this page in the book.|Mark both trees before noon.|We mark the trail.|Will the ferry sail today?|Will it rain?|Will you stay?|Will they?|Will anyone paint the fence?|Will we need a map, or is the rose bed near the gate?|Nobody will know.|It will be cold.|Someone will ring.|The old street market is back.|We hope the frost is over.|They hope to sail.|Hope it stays dry.|Hope you slept well.|Hope to hear the band.|A grace note ends the tune.|Grace period: ten days.|Their grace period is over.|The rose hedge grew.|Rose bushes everywhere.|Prices rose sharply.|Rose tea, please.|May we sit?|It may snow in May.|The bill came in June.|Frank words are rare.|Art and joy matter.|Faith moves mountains.|At dawn we chase crabs.|A grant was given.|He drew two miles of coast.|Put it on the counter @front-desk2 once it dries.|About 86 plates broke before noon.|For bakers this means 79 loaves a day.|Grace notes are short.|It takes 25 minutes or so, no hurry.|We will be back in 12 days.|Between us, the 2 roads differ.|he counts 3 boats on the lake way out|The kettle wi- will boil.|The band will re- rehearse.|We will sa- sail, and Mark- ma- mark it.|The rose bu- bush grew.|Pat the dough, sue nobody.|Rich soil, jack up the car.|one two three, go|one of two|five six people came|nine, ten, eleven birds|a dozen or two, three at most
"""
COMPANIES = "Otter Bakery|Pebble & Sons|Quince Gardens|Tarn Shipping|Umber Tiles|Vale Orchard|Wicker Looms"
FILLER = ["um,", "uh", "hmm,", "er,", "like,", "you know,", "[noise]", "(coughs)"]
ONSETS, CORES, ENDS = "b d f g k l m n p r s t v z st br gr kl".split(), "a e i o u ai ea".split(), "n l r s rd m ck".split()
LASTS = "by with ova lund berg well man ner ski etti ault ardo inger combe".split()
TOWNS = "Bramtoft Eddelow Fernhoe Gullmere Norstrand Quarley Tilbeck".split()
STREET_NAMES = "Abbot Bobbin Cricket Dorset Ember Flint Gorse Hatter".split()
# Fixed value: first names that are ordinary English words, too.
ORDINARY_FIRSTS = "Mark Will Rose Grace Hope May June Bill Frank Jack Faith Joy Pat Grant Drew".split()
# Fixed value: roles in the headers of speakers.
ROLES = "USER PROSPECT INTERNAL EXTERNAL GUEST UNKNOWN".split()
FOLDS = 5


class Sampler:
    """Draws labelled lines; ``kind_of`` knows most of the names it invents."""

    def __init__(self, seed: int, known: float = 0.97) -> None:
        self.rng = random.Random(seed)
        self.kinds: dict[str, int] = {}
        self.known = known
        self.firsts = [self.syllables(2).capitalize() for _ in range(60)] + ORDINARY_FIRSTS
        self.lasts = [(self.syllables(1) + self.rng.choice(LASTS)).capitalize() for _ in range(150)]
        for w in self.firsts:
            if self.rng.random() < self.known:
                self.kinds[w.lower()] = self.kinds.get(w.lower(), 0) | FIRST
        for w in self.lasts:  # surnames are less often known, and some are first names, too
            if self.rng.random() < self.known - 0.07:
                self.kinds[w.lower()] = self.kinds.get(w.lower(), 0) | LAST | (FIRST if self.rng.random() < 0.04 else 0)

    def syllables(self, n: int) -> str:
        return "".join(self.rng.choice(ONSETS) + self.rng.choice(CORES) for _ in range(n)) + self.rng.choice(ENDS)

    def kind_of(self, word: str) -> int:
        return self.kinds.get(word, 0)

    def digits(self, n: int) -> str:
        return self.rng.choice("123456789") + "".join(self.rng.choice("0123456789") for _ in range(n - 1))

    def letters(self, n: int) -> str:
        return "".join(self.rng.choice("ABCDEFGHKLMNPRSTX") for _ in range(n))

    def groups(self, sizes: list[int], sign: str) -> str:
        return sign.join(self.digits(n) for n in sizes)

    def name(self) -> str:
        r, f, l, m = self.rng.random(), self.rng.choice(self.firsts), self.rng.choice(self.lasts), self.rng.choice(self.firsts)
        forms = [f"{f} {l}"] * 8 + [f"{l}, {f}"] * 2 + [f"{f[0]}. {l}", f"{f} {l[0]}.", f"{f}_{l}", f"{l.upper()} {f}", f"{f} {l}".upper(), *[f"{f} {l}".lower()] * 2, f, f, l, l, f"{f} {m} {l}"]
        return forms[int(r * len(forms))]

    def email(self) -> str:
        f, l, c = self.rng.choice(self.firsts).lower(), self.rng.choice(self.lasts).lower(), self.syllables(2)
        local = self.rng.choice([f"{f}.{l}", f"{f[0]}{l}", f"{l}.{f}", f"{f}_{l[:3]}{self.digits(2)}", f"{f}-{l}", f"{f}.{l}+x"])
        host = self.rng.choice([f"{c}.example", f"{c}.test", f"{c}.co.example", f"{c}-mail.example"])
        how = self.rng.randrange(7)
        if how == 0:
            return f"{local}[at]{host}"
        if how == 1:
            return f"{local.replace('.', ' (dot) ')} (at) {host.replace('.', ' (dot) ')}"
        if how == 2:
            return f"{f} {self.rng.choice(['dot', 'underscore'])} {l} at {c} dot {self.rng.choice(['example', 'test'])}"
        return (local + "@" + host).upper() if how == 3 else local + "@" + host

    def spoken(self, n: int) -> str:
        """``n`` digits in words, in one stretch or in groups parted by commas."""
        words = [self.rng.choice(DIGITS.split()[:-2]) for _ in range(n)]
        size = self.rng.choice([n, 3, 4])
        return ", ".join(" ".join(words[k : k + size]) for k in range(0, n, size))

    def phone(self) -> str:
        """International, national and local numbers: a prefix, and groups of digits with one kind of sign between them."""
        r = self.rng
        if r.random() < 0.2:
            return self.spoken(r.choice([7, 10, 11]))
        sign = r.choice([" ", " ", "-", "-", ".", "/", ""])
        sizes = r.choice([[3, 4], [3, 3, 4], [3, 3, 4], [4, 3, 3], [2, 8], [2, 4, 4], [3, 6], [5, 6], [2, 2, 2, 2], [4, 6], [3, 7]])
        body = self.groups(sizes, sign)
        how = r.randrange(7)
        if how == 6:
            return self.digits(r.choice([1, 2])) + sign + body
        if how == 0:
            return f"+{self.digits(r.choice([1, 2, 2]))}{r.choice([' ', '-', '']) if sign else ''}{body}"
        if how == 1:
            return f"00{self.digits(2)}{sign or ' '}{body}"
        if how == 2:
            return f"({self.digits(3)}) {self.groups(sizes[1:], sign if sign != '/' else '-')}" if sum(sizes[1:]) >= 6 else "0" + body
        return "0" + body if how < 5 or sum(sizes) < 7 else body

    def identity(self) -> str:
        """Letters before, behind or between digits, or digits alone in groups; no one country's form."""
        r = self.rng
        if r.random() < 0.12:
            return self.spoken(r.choice([8, 9]))
        sign = r.choice(["-", ".", " ", "/"])
        how = r.randrange(7)
        if how == 0:
            return f"{self.letters(r.choice([1, 2, 3]))}{self.digits(r.choice([6, 7, 8, 9]))}"
        if how == 1:
            return f"{self.letters(2)}{r.choice(['-', ''])}{self.digits(6)}{r.choice('/-')}{self.digits(r.choice([1, 2]))}"
        if how == 2:
            return f"{self.groups(r.choice([[2, 3, 3], [3, 3, 3], [1, 3, 3], [8], [7]]), sign)}{r.choice(['-', ' ', ''])}{self.letters(1)}"
        if how == 3:
            return f"{self.letters(1)}{self.digits(2)} {self.digits(4)}{r.choice(['', ' ' + self.letters(1)])}"
        return self.groups(r.choice([[3, 2, 4], [3, 2, 4], [4, 4, 3], [2, 3, 3, 2], [3, 4, 3], [9], [10], [11]]), sign)

    def address(self) -> str:
        s, t, z = self.rng.choice(STREET_NAMES), self.rng.choice(TOWNS), self.digits(5)
        k = self.rng.choice("Street Road Lane Avenue Ave Blvd Close Way St. Rd Drive Court".split())
        n = str(self.rng.randrange(1, 240))
        words = NUMBERS.split()
        count = self.rng.choice([f"{self.rng.choice(words[19:27])} {self.rng.choice(words[:9])}", self.rng.choice(words[9:19])])
        unit = f"{self.rng.choice(['Flat', 'Unit', 'Apt', 'Suite'])} {self.rng.randrange(1, 60)}"
        forms = [f"{n} {s} {k}, {t} {z}", f"{n} {s} {k}, {t}", f"{n} {s} {k}", f"{unit}, {n} {s} {k}, {t}", f"{unit}/{n} {s} {k}, {t}", f"{s}gasse {n}, {z} {t}", f"{s}weg {n}, {z} {t}", f"{n} rue des {s}s, {z} {t}", f"Via {s} {n}, {t}", f"{n}0 W. {s} {k}, Apt 3B, {t}", f"{count} {s} {k.rstrip('.')} in {t}", f"{n} {s} {k}, {t}".lower()]
        return self.rng.choice(forms)

    def line(self, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.rng
        out, gold, rest = "", [], carrier
        made = {
            "n": (self.name, NAME), "s": (lambda: r.choice(self.firsts if r.random() < 0.8 else self.lasts), NAME), "l": (lambda: r.choice(self.lasts), NAME),
            "e": (self.email, EMAIL), "p": (self.phone, PHONE), "i": (self.identity, ID), "a": (self.address, ADDRESS), "c": (lambda: r.choice(COMPANIES.split("|")), None),
            "t": (lambda: f"{self.letters(r.choice([2, 3, 4]))}-{self.digits(4)}", None), "r": (self.code, None), "v": (lambda: f"{self.digits(1)}.{self.digits(r.choice([1, 2]))}.{self.digits(1)}", None), "k": (lambda: f"{self.digits(2)},{self.digits(3)}", None),
            "o": (lambda: r.choice(ROLES), None), "x": (lambda: self.digits(12), None), "d": (self.date, None), "y": (lambda: self.digits(r.choice([6, 7, 8, 9, 10])), None),
        }
        noisy = r.random() < 0.15
        while "{" in rest:
            before, _, rest = rest.partition("{")
            kind, _, rest = rest.partition("}")
            out += before
            if noisy and before.endswith(" ") and r.random() < 0.5:
                out += r.choice(FILLER) + " "
            make, label = made[kind]
            value = make()
            if label:
                gold.append((len(out), len(out) + len(value), label))
            out += value
        return out + rest, gold

    def code(self) -> str:
        """What is shaped like an identity number and is none."""
        made = self.identity()
        return made if made[-1].isdigit() or made[0].isupper() else self.code()

    def date(self) -> str:
        r = self.rng
        y, m, d = r.randrange(2015, 2030), r.randrange(1, 13), r.randrange(1, 29)
        return r.choice([f"{y}-{m:02}-{d:02}", f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{y}/{m:02}/{d:02}"])


def carriers() -> list[str]:
    return [c for line in CARRIERS.strip().splitlines() for c in line.split("|")]


def labelled_sample(rows: int = 6000, seed: int = 5, fold: int | None = None, held_out: bool = False) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], Sampler]:
    """``rows`` labelled lines (the documented bound of the fit) and the sampler whose ``kind_of`` goes with them.

    With ``fold``, only the carriers outside that fifth of them, or only those in it (``held_out``).
    """
    sampler = Sampler(seed)
    used = [c for k, c in enumerate(carriers()) if fold is None or (k % FOLDS == fold) == held_out]
    return [sampler.line(used[k % len(used)]) for k in range(rows)], sampler
