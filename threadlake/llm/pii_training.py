"""Labelled sentences for the model of pii, made by rule: invented persons, places and numbers among letters, minutes, chat,
forms, code and log lines, in several languages, and among random usual words.

examples(n, seed) gives the same sentences each time; n bounds the sample. train() fits the weights kept in
pii_weights.json (run: python -m threadlake.llm.pii_training).
"""

from __future__ import annotations

import json
import random
from pathlib import Path

from threadlake.llm import pii

Marks = list[tuple[int, int, str]]
# {n} name, {e} e-mail, {p} phone, {i} identity number with its word, {a} address, {w} usual word, {v} no usual word, {W} and {V} the same with a capital, {#3} digits, {x3} hexadecimal digits,
# {g} given name that names a thing, {t} a kind of thing, {f} family name, {s} a street name without a town
_PERSONAL = [
    "{n} will chair the meeting", "we hired {n} in spring", "minutes taken: {n}", "{n} and {n} shared the first prize", "photo: {n}", "my neighbour {n} has a spare key", "the interview with {n} went well", "according to {n} it is finished",
    "{n} phoned twice", "{n} has left the company", "is {n} in the building?", "{n}'s laptop is broken", "speaker: {n}", "Prepared for {n}", "kind regards\n{n}", "yours, {n}", "tenant={n}", '"customer": "{n}"', "<td>{n}</td>", "(see {n}, page {#1})", "edited by {n}", "translated by {n} in {#4}",
    "{n} - head of {w}", "guests: {n}, {n}, {n}", "gestern hat {n} angerufen", "Herzliche Grüße, {n}", "der Vertrag von {n} läuft aus", "{n} est en vacances", "d'après {n}, tout va bien", "{n} llegó tarde", "firmado: {n}", "{n} ha scritto la lettera", "spotkanie z {n}", "звонил {n}", "let {n} know when it is done", "{n} broke the build again",
    "{n} ({e}) will help", "{n} <{e}>", "{n}, {p}", "{n}, {a}", "{n}; {e}; {p}", "patient {n} was seen on Monday", "the keys are with {n}", "{n} said hello", "a letter for {n} has come", "{n} thinks it is fine", "I met {n} at lunch", "{w} {w} {n} {w} {w}", "{n} {w} {w} {w}", "{w} {w} {w} {n}", "{W} {w} {w} {n} {w}", "{w}: {n}", "{w} {n}, {w} {w}", "{n}", "{n} {w}", "@{w} {n} {w}", "— {n}", "{w} of {n} {w}", "{w} is {n}",
    "drop a line at {e}", "my new mail is {e}", "subscribe {e} to the list", "From: {e}", "user={e}", "mail bounced for {e}", "forward it to {e} today", "{e} cannot log in", "invite {e} and {e}", '{{"login":"{e}","id":{#4}}}', "<a href=\"mailto:{e}\">", "https://shop.example/reset?to={e}&k={#3}", "E-Mail: {e}", "Schreib an {e}", "écrivez à {e}", "mi correo es {e}", "{w} {w} {e} {w}", "{e} {w} {w}", "{w} {e}", "{e}", "{w}={e}",
    "ring me on {p}", "the number is {p}", "fax {p}", "Tel. {p}", "Telefon: {p}", "mobile {p} after six", "leave a voicemail at {p}", "my phone, {p}, is off", "dial {p} and wait", "Handy {p}", "téléphone {p}", "teléfono: {p}", "contact {p} or {p}", "{w} {w} {p} {w}", "{p} is busy", "{w} {p}", "{p}", "{w}: {p}", '"tel": "{p}"', "reception {p}, {w}", "{p} ({w})", "her line {p} rings out", "WhatsApp {p}", "phone={p}",
    "{i}", "{i} was typed wrong", "form says {i}", "she gave {i}", "{w} {w} {i}", "please check {i} again", "{i}; {w} {w}", "{w} with {i} {w}", "record: {i}", "{i}, {n}",
    "I live at {a}", "address: {a}", "send the box to {a}", "he moved to {a}", "Anschrift: {a}", "our shop is at {a}", "meet me at {a} at noon", "adresse : {a}", "dirección: {a}", "indirizzo {a}", "{a}", "{w} {w} {a}", "billing: {a}", '"addr": "{a}"', "{a} is where she lives", "the house at {a} was sold", "{w}: {a}. {W} {w}", "return to {a}", "{a} | {w}", "{a} {w} {w} {w}", "the visitors to {a} {w} {w}", "a courier from {a} {w}", "Rechnungsadresse {a}", "Adresse {a}. {W} {w}", "postal address {a}", "shipping to {a} {w} {w}", "the crate to {a} {w} {w}", "the tenant of {a} {w} {w}", "Wohnort {a}", "address {a}. {V} {w}", "adres {a}", "deliver {w} to {a}", "post it to {a}, please",
]
_OTHER = [
    "{W} {W} asked for more {w}", "{W} {W} wrote the {w}", "the {W} {W} is down", "open {W} {W} and {w} it", "{W} {W}", "the {g} {t} is slow", "restart {g} {W} {t}", "{g} {W} {t} {#1}.{#1}", "we use {g} {W} for {w}", "{W} {W} {W} {t}", "read {W} {w} {W}", "switch to the {g} {W} {t}", "the {t} {g} {W} broke", "near {g} {W} {t}", "upgrade {g} {W} {#1}.{#1} now", "click {W} {W} in the {W} menu", "chapter {#1}: {W} {W}", "the {f} {t} is new", "{f} {W} {t} was updated", "{W} {f} {t} failed", "{W} {W} Ltd. sent an {w}", "{g} {W} Inc. is late", "in {W} {f} we trust", "{f} {W} lost {w}", "{W}, {W} and {W} are {w}", "the {f} {f} {t}", "a {W} {f} {w}", "from {W} to {W}", "by {W} {W}, with {W} {W}",
    "look at docs.{w}.org for more", "it failed at {w}.com again", "stay at {w}.net", "meet at {#1}.{#2} pm", "{w} at line {#2}.{#1}", "{w} at {w} dot {w}", "point the {w} at {w}.example", "error at {w}.py:{#2}", "{w}@{#1}x.png", "{w}@{#1}.{#1}.{#2}", "npm i {w}@^{#1}.{#1}.0", "git@{w}.example.com:{w}/{w}.git", "git clone ssh://git@{w}.org/{w}/{w}", "https://{w}.com/@{w}/{w}", "svn+ssh://svn@{w}.net/{w}", "@{w}.{w}(True)", "@{w}/{w}@{#1}.{#2}.{#1}", "r'\\w+@\\w+\\.\\w+'", "x = a@b.T", "user@host:~$ {w}", "{w}@{w}:{#4}", "https://user:pw@{w}.io/{w}.git", "rsync {w}@{w}.internal.lan:/{w} .", "{w}/{w}@sha256:{x32}", "@media (min-width: {#3}px)",
    "build {#4}.{#3}.{#4} is ready", "port {#5} and port {#4}", "from {#1}{#2}.{#2}.{#1}.{#2}:{#4}", "ip 10.{#2}.{#1}.{#2}/24", "rows {#4}-{#4} of {#5}", "rows {#3}-{#3} of {#6}", "sha {x40}", "commit {x8}", "commit {x7} by {w}-bot", "trace {x16}-{x16}", "ticket #{#6}", "issue {#5}", "bug {W}-{#4}", "order {#3}-{#7}", "invoice no. {#8}", "at {#10} ms", "{#10}.{#6}", "epoch={#10}", "ts {#13}", "20{#2}-0{#1}-1{#1} 0{#1}:1{#1}:2{#1}", "20{#2}-0{#1}-1{#1}T0{#1}:1{#1}:2{#1}Z", "1{#1}/0{#1}/20{#2}", "v{#1}.{#2}.{#3}", "{#9} bytes", "{#7} of {#8}", "took {#4}.{#3} s", "checksum {#4} {#4} {#4}", "crc {x8}", "{x8}-{x4}-4{x3}-a{x3}-{x12}", "isbn 978-{#1}-{#3}-{#5}-{#1}", "lot {#3} {#3} {#4}", "serial {#11}", "row {#9} is bad", "batch {#8}", "pi is 3.{#10}", "[{#3}, {#3}, {#4}]", "({#3}, {#3})", "{#3} {#3} {#3} {#3}", "{#2} {#3} {#3} {w}", "size {#8}, offset {#11}", "line {#4}, column {#2}", "0x{x8}", "{w}_{#8}.log", "/{w}/{#9}/{w}", "{w}-{#4}-{#2}-{#2}.txt", "id {#9}", "id={#7}", "uid {#8}", "job {#4}-{#5}", "key {w}-{x8}", "pid {#7}", "release 20{#2}.{#2}.{#2}", "{W}{#8}", "scored {#3}-{#3}", "ratio {#1}.{#7}", "build number {#9}", "session {#8} {w}", "retry {#3} of {#3}", "memory {#9} kB", "+{#3} -{#3}", "+{#1}.{#4}",
    "{#2} {s} tests are red", "the {s} exit is closed", "{#2} {s} was built", "step {#1} {s} failed", "we walked down {s}", "{#1} {s} and {#1} {s}", "see {#2} {s}", "the {#3} {s} fixtures {w}", "level {#1} {s} is hard", "a box of {#2} {w}", "box {#2}, {W}", "{#1} way {w}", "{#3} place {w} moved", "put {#2} {w} in place, {w} them", "drive {#1}, {W}", "row {#2}, {w}", "via {w} {#2}", "court {#1}, {w}", "in {#2} ways, {w} {w}", "close {#3}, {w}", "os {w} {#2}", "place {#3} {w} by {w}", "cours {#1}", "ring {#2}", "the {w} platz {#2}",
    "{w} {w} {w}", "{W} {w} {w} {w}", "{W} {w} {w}: {w} {w}, {w} {#2}", "{w} {#1} {w} {#3} {w}", "{W} the {w} {w} and {w} it", "how does {w} {w} {w}?", "{w}/{w}.{w}", "{W} {w}/{w}_{w}.py has {#2} {w}", "def {w}_{w}({w}, {w}):", "{w}.{w}({#2})", "ERROR {w} {w} {#3}", "WARN {W}{W}: {w}", "{W}{W}.{w}()", '{{"{w}":"{w}","{w}":{#3}}}', "$ {w} --{w}={#2} {w}.json", "# {W} {W}", "- [ ] {w} {w}", "TODO {w} {w}", "{W}. {W}. {W}.", "das {w} ist {w}", "wir haben gestern die neue Fassung geprüft", "der Schalter im Keller klemmt schon wieder", "die Werkzeuge liegen im Schrank neben der Treppe", "мы вчера проверили новую версию отчёта", "сервер перезапущен, ошибок больше не видно", "пожалуйста, посмотри журнал за вторник", "wczoraj sprawdziliśmy nową wersję raportu", "proszę zobaczyć dziennik z wtorku", "nous avons vérifié le rapport mardi dernier", "la porte du garage reste ouverte", "ayer revisamos la nueva versión del informe", "la puerta del almacén sigue abierta", "ieri abbiamo controllato il rapporto", "ontem revisamos o relatório novo", "{v} {v} {w} {w}", "{w} {v} {v}", '{{"{w}":"{v} {v} --{w}={#2}"}}', '{{"{w}":"{v} {v}","{w}":{#4}}}', '{{"{w}":{#4},"{w}":"{v} {v} ./{w}/{w}"}}', 'Shell {{"cmd":"{v} {v} && {v} {w}"}}', 'Find {{"q":"{w} {v}"}}', 'Find {{"q":"{v} {v} {w}"}}', "$ {v} {v} {w}", "run {v} {v} again", "{v} {v}: {w} {w}", "`{v} {v}`", "{w}={v} {v}", "{w}: {v} {v}", "{v} {v} {v}", "by {v} {v} {w}", "- {v} {v}", "{v} {v} failed", "with {v} {v} {v} {w}", "I {v} the {w} and {v} it", "I {w} {V}", "A {V} {w}", "{W} {v} the {w}", "the {v} {v} {w} is {w}", "{v}_{v} {v}", "{v}-{w} {v}-{w} {w}", "the {v} {v} {t}", "{V} {v} {w}", "Die {V} im {V}", "Das {V} und die {V}", "{V}-{w} {V}", "il faut {w} le {w}", "el {w} no {w}", "Monday {#2} May", "{W} {w}, {W} {w}", "I {w} {W} {w}", "{W} {#1} {W} {#2}", "UPDATE {w} SET {w} = {#1} WHERE {w} IN ({#2}, {#3})", "HTTP {#3} {W} {W}", "{w} {W} {w} {W} {w}", "the {W} {w} of {W}", "Read {w}/{w}.md", "Session {x8} {w} {w}", "Commit {x8} {w} the {w} {w}.", "Line {#3} of {w}/{w}_{w}.ts {w} {w}",
]
_THINGS = "service server module cluster library framework theme release page dashboard queue plugin project database button table room package branch engine protocol suite test award hospital hotel airport station park river bridge museum university".split()
_STREET = "street road lane avenue court drive way place square terrace close".split()
_HOSTS = ["example.com", "example.org", "mail.example.net", "post.example", "letterbox.test", "invalid.invalid", "web.de", "mailer.co.uk", "school.edu", "firma.de", "courrier.fr", "correo.es", "poczta.pl", "startup.io", "mx1.provider.net", "ville.fr"]


class _Maker:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        small, large = pii.read_usual()
        # words of Latin letters, most usual first; those that are more often names are no usual words
        self.words = sorted((w for w, r in small.items() if w.isascii() and len(w) > 3 and not (w in large and 2 * large[w] < r) and w not in pii.GIVEN | pii.STOP), key=lambda w: (small[w], w))[:9000]
        self.given_names = sorted(pii.GIVEN)
        self.known = set(small) | set(large) | pii.GIVEN

    def one(self, xs):
        return self.rng.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.one("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.one("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def word(self) -> str:
        return self.words[min(int(self.rng.expovariate(1 / 2500)), len(self.words) - 1)]

    def invented(self, low: int = 2, high: int = 3) -> str:
        """A word of syllables that is not a usual one."""
        while True:
            out = "".join(self.one(["b", "br", "d", "dr", "f", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "r", "s", "sch", "st", "t", "tr", "v", "w", "z", "", "c", "th", "sk", "ž", "ł"][: 27 if self.rng.random() < 0.9 else 29]) + self.one(["a", "e", "i", "o", "u", "ei", "au", "ie", "ä", "ö", "é", "ou", "y"][: 9 if self.rng.random() < 0.8 else 13]) + self.one(["", "", "n", "r", "l", "s", "m", "ck", "nd", "rt", "ll"]) for _ in range(self.rng.randint(low, high)))
            if len(out) > 3 and out not in self.known:
                return out

    def given(self, share: float = 0.6) -> str:
        if self.rng.random() < share:
            return self.one(self.given_names).title()
        return self.invented(1, 3).title() if self.rng.random() < 0.9 else self.one(["Вера", "Марина", "Степан", "Γιώργος", "Łukasz", "Ümit", "Åsa"])

    def family(self) -> str:
        r = self.rng.random()
        if r < 0.12:
            return self.one(["Smith", "Jones", "Miller", "Fischer", "Weber", "Garcia", "Lopez", "Rossi", "Silva", "Novak", "Ivanov", "Kowalski", "Nguyen", "Martin", "Baker", "Young", "Hill", "Stone", "Wood", "Brown", "White", "King", "Wagner", "Becker", "Moreau", "Dubois"])
        name = self.invented(1, 2) + self.one(["", "", "", "son", "sen", "mann", "ov", "ev", "ski", "ez", "ini", "er", "berg", "feld", "ley", "ton", "ic", "aud", "eau", "ska", "enko", "ström", "by", "wald", "i", "a", "o", "u"])
        if len(name) < 4:
            name += self.one(["an", "en", "ek", "is"])
        name = name.title()
        return f"{name}-{self.invented(1, 2).title()}" if r > 0.95 else f"O'{name}" if r > 0.93 else f"Mc{name}" if r > 0.915 else name

    def name(self) -> str:
        g, f, r = self.given(), self.family(), self.rng.random()
        if r < 0.42:
            out = f"{g} {f}"
        elif r < 0.50:
            out = f"{f}, {g}"
        elif r < 0.57:
            out = f"{f.upper()} {g}"
        elif r < 0.64:
            out = f"{g} {f} {self.family()}"
        elif r < 0.71:
            out = f"{g} {self.letters(1)}. {f}"
        elif r < 0.79:
            out = f"{self.letters(1)}. {f}" if self.rng.random() < 0.7 else f"{self.letters(1)}. {self.letters(1)}. {f}"
        elif r < 0.90:
            out = f"{self.one(['Mr', 'Mr.', 'Mrs', 'Mrs.', 'Ms', 'Dr', 'Dr.', 'Prof.', 'Frau', 'Herr', 'Mme', 'Sr.', 'Sra.', 'Señor', 'Pan', 'Pani', 'Miss', 'Sir', 'Don', 'Doña', 'Monsieur', 'Signora'])} {f}"
            if self.rng.random() < 0.2:
                out = out.replace(f, f"{g} {f}")
        elif r < 0.94:
            out = f"{g} {self.one(['van', 'von', 'de', 'della', 'dos', 'van der', 'de la'])} {f}"
        else:
            out = f"{g} {f}"
        case = self.rng.random()
        if case < 0.1 and r < 0.5:
            return out.upper()
        if case < (0.24 if g.lower() in pii.GIVEN else 0.16) and r < 0.42:
            return out.lower()
        return out

    def email(self) -> str:
        g, f = self.given(0.5), self.family()
        local = self.one([f"{g}.{f}", f"{g}_{f}", f"{g}{f}", f"{f}{self.digits(2)}", f"{g[0]}{f}", f"{g}+{self.word()}", f"{g}-{f[:3]}", f"{g}", f"{f}.{g[0]}", self.word(), f"{g}{self.digits(4)}"]).lower()
        local = "".join(c for c in local if c.isascii() and (c.isalnum() or c in "._+-")).strip(".-+_") or "kontakt"
        host = self.one(_HOSTS) if self.rng.random() < 0.5 else f"{self.invented() if self.rng.random() < 0.6 else self.word()}.{self.one(['com', 'org', 'net', 'de', 'io', 'example', 'test', 'example.com', 'invalid', 'example.org', 'co'])}"
        host = "".join(c for c in host if c.isascii())
        r, plain = self.rng.random(), f"{local}@{host}"
        dot = self.one([" dot ", " [dot] ", "[dot]", " (dot) ", "(dot)", "{dot}", " DOT ", "."])
        if r < 0.6:
            return plain
        if r < 0.66:
            return plain.upper()
        if r < 0.72:
            return f"{local}{self.one(['%40', '&#64;', '&commat;'])}{host}"
        if r < 0.9:
            return f"{local}{self.one([' [at] ', '[at]', ' (at) ', '(at)', '{at}', ' at ', ' AT ', '<at>'])}{host.replace('.', dot)}"
        if "." in local and r < 0.93:
            return f"{local.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
        if any(c.isdigit() for c in local) or local in pii.GIVEN:
            return f"{local} at {host}"
        return plain

    def phone(self) -> str:
        d, s = self.digits, self.one([" ", "-", ".", " "])
        body = self.one([
            f"+1{s}{d(3)}{s}{d(3)}{s}{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}{self.one('- .')}{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+1{d(10)}", f"1{d(10)}",
            f"+44 {d(4)} {d(6)}", f"+44 20 {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(10)}", f"0{d(2)} {d(4)} {d(4)}", f"0044 {d(4)} {d(6)}", f"+44{d(10)}", f"+44 7{d(3)} {d(3)}{d(3)}", f"07{d(3)} {d(6)}", f"07{d(9)}",
            f"+49 {d(2)} {d(7)}", f"+49 (0){d(2)} {d(4)} {d(3)}", f"0{d(3)}/{d(6)}", f"0{d(2)}-{d(8)}", f"0049{s}{d(2)}{s}{d(7)}", f"0{d(4)}-{d(5)}", f"+49{d(10)}", f"0{d(3)} {d(7)}",
            f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+39 {d(2)} {d(4)} {d(4)}", f"+48 {d(3)} {d(3)} {d(3)}", f"+61 {d(1)} {d(4)} {d(4)}", f"+61 {d(3)} {d(3)} {d(3)}", f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+81-{d(2)}-{d(4)}-{d(4)}", f"+91 {d(5)} {d(5)}", f"+55 {d(2)} {d(5)}-{d(4)}", f"+351 {d(3)} {d(3)} {d(3)}", f"+{d(2)} {d(9)}", f"+{d(12)}",
        ])
        r = self.rng.random()
        return f"{body} {self.one(['ext. ', 'ext ', 'x', 'ext.'])}{d(self.rng.randint(2, 4))}" if r < 0.08 else f"tel:{body}" if r < 0.12 and body[0] == "+" else body

    def id_number(self) -> tuple[str, str, str]:
        d, L = self.digits, self.letters
        ssn = self.one([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}.{d(2)}.{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", d(9), f"{d(3)}·{d(2)}·{d(4)}", f"{d(3)}–{d(2)}–{d(4)}"])
        kind = self.rng.randint(0, 9)
        word, number = [
            (["SSN ", "SSN: ", "social security number ", "social security no. ", "ssn=", "ssn is ", '"ssn": "', "his social security number was "], ssn),
            (["NI number ", "national insurance number ", "nino ", "NINO: ", "National Insurance: "], self.one([f"{L(2)}{d(6)}{self.one('ABCD')}", f"{L(2)} {d(2)} {d(2)} {d(2)} {self.one('ABCD')}"])),
            (["DNI ", "DNI: ", "NIF ", "NIE ", "documento de identidad "], self.one([f"{d(8)}{L(1)}", f"{d(2)}.{d(3)}.{d(3)}-{L(1)}", f"X{d(7)}{L(1)}", f"{d(8)}-{L(1)}"])),
            (["tax id ", "Steuer-ID ", "Steuernummer ", "taxpayer number ", "TIN ", "numéro fiscal ", "tax number: "], self.one([d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}-{d(7)}", d(10)])),
            (["PESEL ", "pesel: ", "BSN ", "personnummer "], self.one([d(11), d(9), f"{d(6)}-{d(4)}"])),
            (["passport ", "passport no. ", "passport number: ", "Reisepass ", "passeport n° ", "pasaporte ", "passport_no=", "Passport No "], self.one([f"{L(1)}{d(8)}", f"{L(2)}{d(7)}", d(9), f"{L(2)} {d(7)}", f"{L(3)}{d(6)}"])),
            (["national id ", "national ID: ", "identity card ", "ID card no. ", '"nationalId": "', "Personalausweis ", "id card ", "carta d'identità "], self.one([f"{L(2)}-{d(4)}-{d(4)}-{d(2)}", f"{L(2)}{d(10)}", f"{L(2)}{d(6)}{L(2)}", f"{d(4)} {d(4)} {d(4)}", d(12), f"{L(1)}{d(7)}", f"{L(3)}{d(6)}"])),
            (["driving licence ", "driver's license ", "driver license no. ", "licence number ", "Führerschein ", "permis de conduire ", "drivers licence: "], self.one([f"{L(5)}{d(6)}{L(2)}{d(1)}{L(2)}", f"{L(1)}{d(7)}", f"{L(1)}{d(3)}-{d(4)}-{d(4)}", f"{L(5)}{d(6)}{L(1)}9{L(1)}{L(2)}", f"{L(2)}{d(8)}"])),
            (["CPF ", "cpf: ", "CURP "], self.one([f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", d(11)])),
            ([""], f"{d(3)}-{d(2)}-{d(4)}"),
        ][kind]
        left = self.one(word)
        return left, number, '"' if left.endswith('"') else ""

    def street(self) -> str:
        return self.one([self.word().title(), self.invented(1, 2).title(), self.invented(2, 2).title(), f"{self.word().title()} {self.word().title()}", self.given()])

    def town(self) -> str:
        a = self.invented(2, 3).title()
        return self.one([a, a, f"{a} {self.one(['Bay', 'Hill', 'Heath', 'Falls', 'Cross', 'Park'])}", f"{self.one(['Lower', 'Upper', 'New', 'Old', 'Port', 'Saint', 'Great', 'West', 'East', 'North'])} {a}", f"{self.word().title()}{self.one(['ton', 'field', 'ford', 'burgh', 'wood'])}", self.word().title()])

    def address(self) -> str:
        d, st, town = self.digits, self.street(), self.town()
        n = str(self.rng.randint(1, 2400)) + self.one(["", "", "", "", "a", "B"])
        kind = self.one(_STREET + ["st", "rd", "ave", "blvd", "dr", "ct", "ln"]).title() + self.one(["", "", "", "."])
        kind = kind if len(kind.strip(".")) < 5 else kind.strip(".")
        unit = self.one(["", "", "", f", Apt {d(2)}", f" Apt {d(1)}C", f", Suite {d(3)}", f", Unit {d(1)}", f" #{d(2)}"])
        state, after = self.letters(2), self.one([", ", ", ", "\n"])
        british, german = f"{self.letters(2)}{d(1)} {d(1)}{self.letters(2)}", self.invented(2, 2).title() + self.one(["straße", "weg", "gasse", "platz", "allee", "str.", "damm"])
        way = self.one([
            f"{n} {st} {kind}{unit}{after}{town}", f"{n} {st} {kind}{unit}{after}{town}, {state} {d(5)}", f"{n} {st} {kind}{unit}{after}{town} {d(self.one([4, 5]))}", f"{n} {st} {kind}{after}{town}{after}{british}", f"{n} {st} {kind}{after}{town} {british}", f"{n} {self.one('NSEW')}. {st} {kind}{unit}{after}{town}, {state} {d(5)}", f"{n} {self.one(['North', 'South', 'E', 'W'])} {st} {kind}{unit}{after}{town}",
            f"{self.one(['Flat', 'Unit', 'Apartment'])} {d(1)}, {n} {st} {kind}{after}{town}", f"{german} {d(2)}{after}{d(5)} {town}", f"{german} {d(2)}{self.one(['', 'a', ' b'])}{after}{self.one(['', 'D-', 'A-'])}{d(5)} {town}", f"{self.one(['Alte', 'Neue', 'Große'])} {german} {d(1)}, {d(5)} {town}", f"{self.one(['Am', 'Zum'])} {st}weg {d(2)}, {d(5)} {town}",
            f"{self.one(['Calle', 'Avenida', 'Plaza', 'Calle de la', 'Paseo del'])} {st}{self.one(['', ','])} {d(2)}, {d(5)} {town}", f"Calle {st} {d(2)}, {d(1)}º {self.letters(1)}, {d(5)} {town}", f"{self.one(['Via', 'Viale', 'Piazza'])} {st} {d(2)}, {d(5)} {town}", f"{self.one(['Rua', 'Travessa'])} {st}, {d(2)}, {d(4)}-{d(3)} {town}",
            f"{n}{self.one(['', ',', ' bis', ' bis,', ' ter,'])} {self.one(['rue', 'avenue', 'boulevard', 'place', 'impasse', 'chemin'])} {self.one(['de ', 'des ', 'du ', 'de la ', ''])}{st}, {d(5)} {town}", f"{self.one(['ul.', 'al.', 'os.'])} {st} {d(2)}{self.one(['', f'/{d(1)}', f' m. {d(1)}'])}, {d(2)}-{d(3)} {town}",
            f"{self.one(['P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box'])} {d(3)}, {town}", f"PO Box {d(4)}, {town}, {state} {d(5)}", f"Postfach {d(4)}, {d(5)} {town}", f"Apartado {d(3)}, {d(5)} {town}", f"BP {d(3)}, {d(5)} {town}",
        ])
        r = self.rng.random()
        return way.lower() if r < 0.2 else way.upper() if r < 0.28 and "ß" not in way else way

    def piece(self, pattern: str) -> tuple[str, Marks]:
        out, marks = "", []
        at = 0
        while at < len(pattern):
            ch = pattern[at]
            if pattern[at : at + 2] in ("{{", "}}"):
                out, at = out + ch, at + 2
                continue
            if ch != "{":
                out, at = out + ch, at + 1
                continue
            end = pattern.index("}", at)
            code, at = pattern[at + 1 : end], end + 1
            if code[0] in "nepa" and len(code) == 1:
                kind, body = {"n": ("name", self.name), "e": ("email", self.email), "p": ("phone", self.phone), "a": ("address", self.address)}[code]
                text = body()
                s = len(out) + (4 if text.startswith("tel:") else 0)
                marks.append((s, len(out) + len(text), kind))
            elif code == "i":
                left, text, right = self.id_number()
                marks.append((len(out) + len(left), len(out) + len(left) + len(text), "id_number"))
                text = left + text + right
            elif code[0] == "#":
                text = self.digits(int(code[1:]))
            elif code[0] == "x":
                text = "".join(self.one("0123456789abcdef") for _ in range(int(code[1:])))
            else:
                text = {"w": self.word, "W": lambda: self.word().title(), "g": lambda: self.one(self.given_names).title(), "t": lambda: self.one(_THINGS), "f": lambda: self.invented(2, 3).title(), "v": self.invented, "V": lambda: self.invented().title(), "s": lambda: f"{self.street()} {self.one(_STREET).title()}"}[code]()
            out += text
        return out, marks

    def text(self) -> tuple[str, Marks]:
        out, marks = "", []
        for k in range(self.rng.randint(1, 5)):
            if k:
                out += self.one([". ", ". ", ". ", ", ", "; ", " | ", "\n", " ", " - "]) if out[-1] not in ".?\n" else self.one([" ", "\n"])
            piece, more = self.piece(self.one(_PERSONAL if self.rng.random() < 0.5 else _OTHER))
            marks += [(s + len(out), e + len(out), kind) for s, e, kind in more]
            out += piece
        return out, marks


def examples(n: int = 12_000, seed: int = 11) -> list[tuple[str, Marks]]:
    maker = _Maker(random.Random(seed))
    return [maker.text() for _ in range(n)]


def train(n: int = 12_000, seed: int = 11) -> pii.Weights:
    return pii.train_weights(examples(n, seed))


if __name__ == "__main__":
    target = Path(__file__).parent / "pii_weights.json"
    target.write_text(json.dumps(train(), indent=0, ensure_ascii=False) + "\n")
