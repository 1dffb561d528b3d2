"""The labelled table from which the tagger of personal data is trained.

Sentence frames written for this project with marked gaps, after reading test messages and the
tagger's errors on them; the gaps are filled from a seeded
generator, so the table is ``N_ROWS`` rows of text with their spans, always the same.  ``{P}``
is a person, ``{E}`` an e-mail address, ``{T}`` a phone number, ``{I}`` an identity number and
``{A}`` a street address; ``{W}`` is a capitalised word that is none of these, ``{C}`` a place,
``{#n}`` n digits, ``{S}`` a sentence without personal data.
"""

from __future__ import annotations

import random
import re

#: Rows of the table, and the seed of its generator.
N_ROWS, SEED = 9000, 11

CATEGORY = {"P": "PERSON", "E": "EMAIL", "T": "PHONE", "I": "ID_NUMBER", "A": "ADDRESS"}

FIRST = (
    "Anna Ben Clara David Elif Frank Greta Hugo Irene Jonas Karim Lena Marta Nora Omar Paula Quinn Rosa Stefan Tessa Ugo Vera Walter Xenia Yasmin Zoe Anneliese Björn Chidi Dario Emeka Fenna "
    "Goran Hanne Ilse Joaquín Kaito Leila Maëlle Nils Odile Piotr Ravindra Sunita Tariq Ulrich Vesna Wiebke Yara Zdenek Søren Théa Valentín Håkan Meiling Ottilie Will Mark Grace April Rose"
).split()
STEM = "Ald Bar Cor Dal Ebb Fal Gar Hol Ing Jar Kel Lam Mor Nev Ort Pal Rad Sal Tor Ulm Var Wal Yor Zan Brid Crom Drav Grin Hart Kess Lund Marl Pren Stav Thor Vint".split()
TAIL = "man mann son sen ski ska ström berg ford wick wood more ley low ton idze escu ova ov elli etti ini aki ero ano vang holm holt feld dottir áček ault ard well field ridge hart man".split()
PLACE_TAIL = "ville ford burg dorf ham stead port mouth brook haven field dam hausen ilia wick falls".split()
WORD = "Copper Linden Harrow Velvet Juniper Saffron Walnut Pebble Maple Cedar River Garden Summit Falcon Amber Silver Granite Meadow Orchard Willow Quarry Bramble Cobalt Umber Thistle Sable Marlow Fennel Winter Rosalind Wanda Stella Victoria Madison Jordan Austin Chelsea Sterling Mercury Apollo".split()
COMMON = "Ward Form Invoice Order Part Room Route Bus Batch Version Monday Friday April March May Tuesday January Update".split()

SENTENCES = """
the portal shows an empty page again
the booking tool repeats the last page since Monday
my invoice lists the wrong dose on my phone
the referral ignores every second line as you said
ward 4 has lost the Friday slot after the update
our printer never saves one attachment and nobody knows why
this chart mixes up two columns, I think
the sick note asks for half of the text for April
the lab sheet needs the footnotes (see above)
your summary still lists a blank field
the pharmacy dropped an old date
the second reminder skips a signature
the meal plan shows the tariff
the draft letter asks for the copy for Monday
that form still lists a signature
this summary never saves the Friday slot
our export dropped the dose (see above)
your appointment shows every second line again
is it true that the page is blank
de bijlage ontbreekt
de pagina toont een lege regel
een collega zoekt de bijlage
die Seite bleibt leer
der Anhang fehlt leider
mein Termin zeigt das alte Datum
les notes manquent encore
la página sale en blanco
mi cita no aparece
das Formular zeigt die letzte Seite
das Portal wiederholt den Anhang, glaube ich
die Rechnung verliert eine Unterschrift seit Montag
der Bericht vergisst zwei Spalten nach dem Update
der Arztbrief braucht das Datum wieder
die Station zeigt eine leere Seite
le portail affiche la dernière page encore
la facture perd deux colonnes depuis lundi
ce rapport demande une date sur mon téléphone
le formulaire répète une signature
el portal muestra una firma en mi móvil
la factura repite la última página
este informe pierde dos columnas otra vez
el formulario pide una fecha desde el lunes
het portaal toont twee kolommen weer
de rekening vraagt een handtekening
dit verslag verliert een datum
het formulier herhaalt de laatste pagina sinds maandag
""".strip().split("\n")

POSITIVE = r"""
My name is {P} and I cannot open the portal.
My name is {P}.
I am {P} from the night shift.
Name: {P}
Name: {P}\nAddress: {A}\nTel: {T}
Name: {P}\nAddress: {A}
Name: {P}\nAnschrift: {A}\nMail: {E}
Address: {A}
Tel: {T}
tel:{T}
Mail: {E}
mailto:{E}
Reach me:{E}
{P} signed the consent form.
{P} said {S}.
{P}: {S}
{P} thinks {S}.
{P} says {S}
{P} found that {S}.
{P} agrees that {S}
Even {P} agrees that {S}
Even {P} agrees that {S}.
Only {P} knows that {S}.
Thanks! {P} x
Thanks!\n{P} x
Maybe {P} can help.
Perhaps {P} knows.
Both {P} and {P} found that {S}.
{P} and {P} both replied.
Either {P} or {P} will call.
According to {P}, {S}.
Ask {P} or {P} at the desk.
I spoke to {P} about this on Tuesday.
{S}, said {P}.
{S} - {P}
Regards,\n{P}
Regards,\n{P}\n{T}
Kind regards\n{P}\n{A}
Best,\n{P}
Thanks, {P}
Hi {P},
Hello {P},
Dear {P},
Dear Dr. {P},
Dear Mr {P},
Mrs {P} wants the invoice sent to {E}.
Dr. {P} took the call from {T}.
Nurse {P} noted it.
Ms {P} called twice.
Professor {P} teaches on Monday.
{P} took the call from {T}.
Her father, {P}, was born here.
Her sister {P} lives at {A}.
His brother {P} works in {C}.
My daughter {P} is ill.
I'm {P}'s carer.
{P}'s file is missing.
The record is under {P}, {E}.
The booking is for {P}.
Emergency contact: {P} / {T}
Patient {P} ({L} {I}) was moved to ward 4.
Patient {P} ({L}: {I}) was moved to ward 4.
Patient {P} was moved to ward 4.
Deliver to {P} at {A} before noon.
Mail it c/o {P}, {A}.
Ship the replacement to {A}.
I moved to {A} last week.
Old address {A}; new address {A}
At {A} {S}.
As {S}, I went to {A} in person.
Please update {L} {I} and {A} in the file.
Verify {L} {I} before the visit.
{L} {I}, please confirm.
{L}: {I}, please confirm.
my file is {L} {I}.
{S}; my file is {L} {I}.
{'id': '{L} {I}'}
{"contact":"{E}","who":"{P}"}
From: "{P}" <{E}>
To: {P} <{E}>
{P} <{E}> wrote:
cc {E}; {E}
is {E} still your address?
You can write to {E} or phone {T}.
When {S}, write to {E} instead.
If {S}, call {T}.
Please call me back on {T} after lunch.
my number changed, it's {T} now
text me {T} or {T}
fax {T}, mail {E}, visit {A}
{T} rings but {S}.
{T} rings but {S}.
{T} is my new number.
{S} ({E}, {T})
{S} ({E}).
{S} ({T}).
name,phone,email\n{P},{T},{E}
{P},{T},{E}
| {P} | {A} | {T} |
| {P} | {T} |
<p>{P}</p><p>{A}</p>
<td>{P}</td><td>{E}</td>
{P}
{P}\n{A}
Mein Name ist {P} und das Portal geht nicht.
Sehr geehrter Herr {P},
Sehr geehrte Frau {P},
Herr {P} bittet um Rückruf: {T}
Frau {P} wartet auf Antwort.
Hallo {P},
Meine Tochter {P} ist krank.
{P} sagt, {S}.
Mit freundlichen Grüßen\n{P}
Mit freundlichen Grüßen\n{P}\n{A}
Anschrift: {A}
Ich wohne in der {A}.
Patient {P}, {LD} {I}, wurde verlegt.
Patient {P}, {LD}: {I}, wurde verlegt.
{LD} {I} liegt bei.
{LD}: {I} liegt bei.
{LD} {I}: {S}.
{LD}: {I}: {S}.
Bitte rufen Sie unter {T} zurück.
Falls {S}, bitte {T} anrufen.
Schreiben Sie an {E}.
{S}, schreibt {E}.
{S}, {A}.
Laut {P} {S}.
{P} meint, {S}.
{P} hat schon unterschrieben.
Grüße, {P}
Ich wohne jetzt in der {A}.
Selon {P}, {S}.
D'après {P}, {S}.
{P} a déjà signé.
Ma fille {P} est malade.
Según {P}, {S}.
{P} ya firmó.
El señor {P} ya firmó. 
Mi hija {P} está enferma.
Mi documento es {I}.
Volgens {P} {S}.
{P} heeft al getekend.
Mijn dochter {P} is ziek.
Bel {T} als het zo is.
Dr. {P} asked for the copy.
Prof. {P} and {P} asked for the copy.
Prof. {P} called.
{P} asked for {T}.
The account is under {P}, {E}.
Signed, {P}
{S}? {P}
{S}. {P}
{S}! {P} signed the consent form.
Je m'appelle {P} et je ne peux pas entrer.
Bonjour {P},
{P} dit : {S}.
Mme {P} attend une réponse.
M. {P} a rappelé.
Cordialement,\n{P}
Mon adresse : {A}.
Au {A}, {S}.
J'habite {A}.
Rappelez-moi au {T}.
Écrivez à {E} svp.
{S} ({E}).
Voici mon {LF} {I}.
Voici mon {LF} : {I}.
Me llamo {P} y no puedo entrar.
Hola {P},
La señora {P} espera respuesta.
El señor {P} llamó ayer.
Saludos,\n{P}
Vivo en {A}.
En {A} {S}.
Mi correo es {E}.
Si {S}, llame al {T}.
Llámeme al {T}.
Le mando {LS} {I}.
Le mando {LS}: {I}.
Mijn naam is {P} en ik kan niet inloggen.
Beste {P},
Mevrouw {P} wacht op antwoord.
Meneer {P} belde.
Groet,\n{P}
Ik woon op {A}.
Bel me op {T}.
Mail naar {E} graag.
Mijn {LN} {I} staat in het dossier.
Mijn {LN}: {I} staat in het dossier.
""".strip().split("\n")

NEGATIVE = """
{S}. {S}
{S}! {S}.
{S}... {S}
{S}? {S}!
{S}, {S}.
{S} {S}
Meting {#3}.{#6} om 14:05.
{S}.
{S}!
{S}
{S}...
Thanks, that helped.
I tried a second browser, no luck.
Let me check that for you.
Please translate the paragraph into plain English.
Can you summarise the meeting notes in five lines?
Will March be better than April?
{S} for April.
{S} for April
{S} for April...
{S} for April!
{S} for April? {S}
{S} since May.
{S} for June, I think.
{S} before March, said the nurse.
In April {S}.
Everything else is fine.
Everything else is fine
Everything else works.
Everything looks fine today.
Case law {#4}/{#2} is not relevant.
Which plan covers dental work?
Which form do I need?
What does the error mean?
It worked this morning.
It works on my laptop.
The export stops half way.
The attachment is missing.
The dosage table looks wrong.
Here is a shorter version.
I'd rather not use the app.
I have noted the request.
Sorry for the delay.
Could you draft a polite reminder?
Answer briefly. Do not reveal personal data.
You are a helpful support agent.
Reply in plain English.
Nothing has changed since Tuesday.
Someone called twice.
Nobody answered the phone.
Anything else?
Please wait a moment.
Vielen Dank im Voraus.
Der Fehler kommt immer wieder.
Alles andere ist in Ordnung.
Nichts hat sich geändert.
Tout le reste va bien.
Rien n'a changé.
Todo lo demás está bien.
Nada ha cambiado.
Verder is alles goed.
De rekening klopt niet.
De rekening verliest een datum.
Het dossier is leeg.
Meet me at noon dot or later.
Order {#8} left the depot.
Invoice {#4}/{#4} covers 12 Main points.
Part no. {#3}-{#2}-{#4}X is discontinued.
Batch {#3} {#3} {#3} expired.
Lot {#9} passed, lot {#9} failed.
Ticket #{#7} is still open.
Serial {#4}-{#4}-{#4} is on the back.
Tracking {U2}{#9}{U2} shows no movement.
ISBN-like code {#13}.
Grid ref {U2} {#5} {#5}.
Build {#1}.{#2}.{#3} fails with code {#3}.
Ratio {#3}-{#2} held over {#4} samples.
Reading was {#3}.{#6} at 14:05.
Reading was {#3}.{#9} at 14:05.
p = 0.{#9}
Temperature 38.{#2} for 3 days.
Dose: {#3} mg, then {#2} mg.
Form {U2}-{#3} replaces form {U2}-{#3}.
Flight {U2} {#3} landed late.
Port {#4}, host {W}.local
Room {#3}, North Wing, {C} Hospital.
Ward {#1}, bed {#2}.
Bus {#3} stops on {W} Avenue.
Route {#2} is closed until May.
The {W} Street edition sold out.
The {W} chair is sold out.
The {W} {W} range is back.
Storm {W} closed the road to {C}.
Hotel {W} in {C} ist ausgebucht.
Project {W} starts on Monday.
The {W} server is down.
We serve {W} & {W} Ltd in {C}.
The {W} & {W} catalogue has {#3} pages.
{C} & Daughters Ltd sent the quote.
{W} & Sons sent the quote.
{W} Inc. and {W} GmbH merged.
{W} Bank opened in {C}.
The {C} Clinic is closed.
We drove from {C} to {C}.
He lives near {C}.
@{W}{#2} posted a review.
git@{W}: permission denied
Use {W}@{#2}.{#1} as the version pin.
[PHONE_REDACTED] rang twice.
[PERSON_{#1}] sent [EMAIL_{#1}].
Ask [PERSON_0] about [ADDRESS_1].
{W} University offers a course.
Raum {#3}, Haus Nord.
Messwert {#3}.{#6} um 14:05 Uhr.
Auftrag {#8} ist unterwegs.
Rechnung {#4}/{#4} umfasst 12 Posten.
Der Anhang fehlt leider.
Ich prüfe das gern.
Gestern ging es noch.
Können Sie den Text kürzen?
Antworten Sie höflich.
See section {#2}.{#1}.{#3}.
See page {#3} of chapter {#1}.
Flight {#3} lands at gate {#2}.
Even the portal is slow.
Will you call back?
May I ask a question?
¿Puede resumir el texto?
¿Puede corregir la carta?
¿Qué significa el error?
Vielen Dank für die Hilfe.
Gracias por la ayuda.
Ayer funcionaba.
Merci pour votre aide.
Gisteren werkte het nog.
Bedankt voor de hulp.
Selon le rapport, la page reste vide.
Bel morgen terug.
The {W} Hill edition sold out.
Gate {#2}, seat {#2}{U1}.
Model {U2}{#3} costs {#3} dollars.
{#4}-{#2}-{#2} {#2}:{#2} UTC
1.{#1}.{#2} was released in {#4}.
Salle {#3}, aile nord.
Valeur {#3}.{#6} à 14:05.
Commande {#8} expédiée.
La route {#2} est fermée.
La page reste vide.
Hier tout marchait.
Pouvez-vous résumer le texte ?
Sala {#3}, ala norte.
Valor {#3}.{#6} a las 14:05.
El pedido {#8} está en camino.
Muchas gracias.
Falta el archivo.
Bestelling {#8} is onderweg.
De pagina blijft leer.
Dank u wel.
Kunt u de tekst inkorten?
name,phone,email
{"action": "book", "ref": {#5}}
Version {#1}.{#1} of {W} Desk is out.
The {W} Prize went to the {W} team.
The {W} act passed in {#4}.
{#2} items, {#3} pages, {#1} left.
""".strip().split("\n")

LABELS = {
    "L": ["SSN", "SSN:", "social security number", "Soc. Sec. No.", "my social is", "MRN", "MRN:", "medical record no.", "chart number", "Member ID", "member id", "insurance number", "policy no.", "passport", "passport no.", "travelling on passport", "driver's license", "driving licence no.", "national id", "tax id", "TIN", "ITIN", "PESEL", "health plan id", "health card no.", "DL#", "DL", "ID no.", "Member no.", "NHS number", "NI number"],
    "LD": ["Steuer-ID", "Ausweisnummer", "Versichertennummer", "Personalausweis", "Reisepassnummer", "Sozialversicherungsnummer", "Führerscheinnummer", "Patientennummer", "Steuernummer"],
    "LF": ["NIR", "n° de sécurité sociale", "numéro de passeport", "permis de conduire", "numéro fiscal", "n° de dossier médical"],
    "LS": ["DNI", "NIF", "NIE", "documento", "pasaporte", "número de la seguridad social", "carné de conducir"],
    "LN": ["BSN", "bsn", "burgerservicenummer", "paspoortnummer", "rijbewijsnummer", "zorgverzekeringsnummer"],
}
PREFIX = ["", "", "", "", "", "PS: ", "1) ", "> ", "** ", "- ", "🙂 ", "Re: ", "btw ", "… ", "\t", "| "]
JOIN = [" ", " ", "  ", "\n", "\n", "\n\n", " 🙂 "]


class _Fill:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def upper(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def last(self) -> str:
        r = self.r
        name = r.choice(STEM) + r.choice(TAIL)
        k = r.random()
        if k < 0.06:
            name = "Mac " + name
        elif k < 0.1:
            name = r.choice(["O'", "D'", "Mc"]) + name
        elif k < 0.16:
            name = r.choice(["van der ", "van ", "de la ", "von ", "al-", "de ", "di ", "El "]) + name
        elif k < 0.22:
            name = f"{name}-{r.choice(STEM)}{r.choice(TAIL)}"
        elif k < 0.3:
            name = r.choice(["Bell", "Young", "Stone", "Winter", "Frost", "Marsh", "Baker", "Rivers", "King", "Brook"])
        return name

    def first(self) -> str:
        return self.r.choice(FIRST) if self.r.random() < 0.8 else self.r.choice(STEM) + self.r.choice(["a", "o", "ia", "e", "is", "us", "in"])

    def person(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.45:
            name = f"{self.first()} {self.last()}"
        elif k < 0.55:
            name = f"{self.first()} {self.first()} {self.last()}"
        elif k < 0.63:
            name = f"{self.first()} {self.upper(1)}. {self.last()}"
        elif k < 0.69:
            name = f"{self.upper(1)}. {self.last()}"
        elif k < 0.73:
            name = f"{self.first()} {self.upper(1)}."
        elif k < 0.79:
            name = f"{self.last()}, {self.first()}"
        elif k < 0.9:
            name = self.first()
        else:
            name = self.last()
        if r.random() < 0.07:
            name = name.upper()
        if r.random() < 0.02:
            name = name.replace(" ", "  ")
        return name

    def email(self) -> str:
        r = self.r
        a, b = (re.sub(r"[^\w]", "", x).lower() for x in (self.first(), self.last()))
        user = r.choice([f"{a}.{b}", f"{b}.{a[0]}+{r.choice(WORD).lower()}", f"{a[0]}{b}", f"{b}_{a}", f"{a}{self.digits(2)}", f"{a}-{b}{self.digits(2)}", f"{a}.{b}{self.digits(1)}"])
        host = r.choice([r.choice(WORD).lower() + r.choice(["", "-clinic", self.digits(2)]), "mail." + r.choice(WORD).lower(), "example", "post." + r.choice(WORD).lower() + ".co", "münz-" + r.choice(WORD).lower()])
        top = r.choice(["example", "test", "invalid", "org", "net", "com", "de"])
        k = r.random()
        if k < 0.68:
            out = f"{user}@{host}.{top}"
        elif k < 0.74:
            out = f"{user}＠{host}.{top}"
        elif k < 0.8:
            out = f"{user} [at] {host}.{top}"
        elif k < 0.86:
            out = f"{user}(at){host}.{top}".replace(".", "(dot)") if r.random() < 0.6 else f"{user} (at) {host}.{top}"
        elif k < 0.95:
            out = f"{user} at {host} dot {top}" if "." not in host else f"{user} at " + host.replace(".", " dot ") + f" dot {top}"
        else:
            out = f"{user} @ {host}.{top}"
        return out.upper() if r.random() < 0.08 else out.capitalize() if r.random() < 0.05 else out

    def phone(self) -> str:
        r, d = self.r, self.digits
        area, mid, end = r.choice("23456789") + d(2), r.choice(["555", d(3)]), d(4)
        s = r.choice(["-", ".", " "])
        dash = r.choice(["-", "-", "–"])
        out = r.choice(
            [f"{area}{s}{mid}{s}{end}", f"{area}{s}{mid}{s}{end}", f"({area}) {mid}{dash}{end}", f"+1 {area} {mid} {end}", f"+1 ({area}) {mid}{dash}{end}", f"1-{area}-{mid}-{end}", f"+1{area}{mid}{end}", f"{area}{mid}{end}",
             f"+44 7700 {d(6)}", f"+44 (0)20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"07700 {d(6)}", f"+49 30 {d(5)} {d(3)}", f"+49 (0)30 {d(8)}", f"030 {d(7)}", f"0171 {d(7)}", f"030/{d(7)}", f"030/{d(5)}-{d(3)}", f"+49 30 {d(5)}-{d(3)}",
             f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"{r.choice('69')}{d(2)} {d(3)} {d(3)}", f"+31 6 {d(8)}", f"06-{d(8)}", f"020 {d(3)} {d(4)}", f"06 {d(8)}"]
        )
        return out + r.choice([f" ext. {d(3)}", f" x{d(3)}"]) if r.random() < 0.06 else out

    def identity(self, label: str) -> str:
        r, d, u = self.r, self.digits, self.upper
        low = label.lower()
        if "ssn" in low or "soc" in low or "tin" in low:
            return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)])
        if "mrn" in low or "record" in low or "chart" in low or "dossier" in low or "patientenn" in low:
            return r.choice([d(8), f"00-{d(2)}-{d(3)}", d(7), f"{u(1)}{d(6)}", f"{u(2)}-{d(6)}", f"{u(2)}-{d(5)}"])
        if "licen" in low or low.startswith("dl") or "permis" in low or "conducir" in low or "rijbewijs" in low or "führer" in low:
            return r.choice([f"{u(1)}{d(3)}-{d(4)}-{d(4)}", f"{u(1)}{d(7)}", d(10)])
        if "pass" in low or "pasa" in low or "paspoort" in low or "reise" in low:
            return r.choice([f"{u(1)}{d(8)}", f"{u(2)}{d(8)}", d(8), f"{u(1)}{d(2)}{u(1)}{d(5)}"])
        if "ausweis" in low:
            return f"{u(1)}{d(2)}{u(1)}{d(5)}"
        if "steuer" in low or "fiscal" in low:
            return r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11)])
        if low in ("nir",) or "sécurité" in low:
            return r.choice([f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", d(13), d(15)])
        if low in ("dni", "nif", "nie"):
            return r.choice([f"{d(8)}{u(1)}", f"{d(8)}-{u(1)}", f"X{d(7)}{u(1)}"])
        if "bsn" in low or "burger" in low:
            return r.choice([d(9), f"{d(4)}.{d(2)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}"])
        return r.choice([d(11), d(10), f"{u(3)}{d(9)}", f"{u(1)}{d(9)}", f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}", f"{d(3)} {d(3)} {d(4)}"])

    def place(self) -> str:
        return self.r.choice(STEM) + self.r.choice(PLACE_TAIL) if self.r.random() < 0.85 else self.r.choice(STEM) + " Falls"

    def address(self, lang: str) -> str:
        r, d = self.r, self.digits
        n = str(r.randint(1, 9999) if lang == "en" else r.randint(1, 250))
        w = r.choice(WORD) if r.random() < 0.5 else r.choice(STEM) + r.choice(["en", "er", "el", "ing"])
        if lang == "de":
            street = r.choice([f"{w}straße {n}", f"{w}str. {n}", f"{w}weg {n}", f"{w}er Weg {n}", f"Am {w}platz {n}", f"{w}gasse {n}", f"{w}allee {n}", f"An der {w}brücke {n}"]) + r.choice(["", "", "", "a", " b"])
            return street + (f", {d(5)} {self.place()}" if r.random() < 0.5 else "")
        if lang == "fr":
            n += r.choice(["", "", "", " bis"])
            street = r.choice([f"{n} rue des {w}s", f"{n}, rue de {w}", f"{n}, boulevard {w}", f"{n}, avenue du {w}", f"{n} place {w}", f"{n}, impasse du {w}"])
            return street + (f", {d(5)} {self.place()}" if r.random() < 0.6 else "")
        if lang == "es":
            street = r.choice([f"Calle del {w} {n}", f"Calle {w}, {n}", f"C/ {w} {n}", f"Avenida de {w}, {n}", f"Plaza {w} {n}", f"Paseo del {w} {n}"]) + r.choice(["", "", ", 5º C", ", 2º B"])
            return street + (f", {d(5)} {self.place()}" if r.random() < 0.5 else "")
        if lang == "nl":
            street = r.choice([f"{w}straat {n}", f"{w}laan {n}", f"{w}gracht {n}", f"{w}weg {n}", f"{w}plein {n}"]) + r.choice(["", "", f"-{d(1)}", "a"])
            return street + (f", {d(4)} {self.upper(2)} {self.place()}" if r.random() < 0.6 else "")
        if r.random() < 0.15:
            return r.choice(["PO Box ", "P.O. Box ", "P. O. Box "]) + str(r.randint(10, 9999))
        kind = r.choice("Street St St. Avenue Ave Road Rd Rd. Lane Ln Drive Dr Court Ct Way Boulevard Blvd Terrace Place Hill".split())
        name = r.choice([w, w, f"{w} Creek", f"{w} Hill", f"{w}field", f"{r.choice(['North', 'South', 'East', 'West', 'N.', 'S.'])} {w}", f"East {w} Hill", f"N. {w}field"])
        out = f"{n} {name} {kind}"
        if r.random() < 0.3:
            out += r.choice([", ", " ", "\n"] if r.random() < 0.3 else [", "]) + r.choice([f"Apt {d(2)}{r.choice(['', 'A', 'B'])}", f"Suite {d(3)}", f"Unit {d(1)}", f"#{d(2)}"])
        if r.random() < 0.5:
            out += f", {self.place()}, {self.upper(2)} {d(5)}"
        return out.upper() if r.random() < 0.06 else out.lower() if r.random() < 0.04 else out


_GAP = re.compile(r"\{(P|E|T|I|A|W|C|S|L[DFSN]?|U\d|#\d+)\}")
_LANG = {"de": ("Anschrift", "wohne", "Grüßen", "bitte"), "fr": ("adresse :", "Au {A}", "habite"), "es": ("Vivo", "En {A}"), "nl": ("woon",)}


def _language(frame: str, r: random.Random) -> str:
    for lang, words in _LANG.items():
        if any(w in frame for w in words):
            return lang
    return r.choice(["en", "de", "nl"]) if frame.startswith("{S}, {A}") else "en"


def _filled(frame: str, f: _Fill) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at, label = "", [], 0, "id"
    lang = _language(frame, f.r)
    for m in _GAP.finditer(frame):
        text += frame[at : m.start()]
        g, at = m.group(1), m.end()
        if g in LABELS:
            value = label = f.r.choice(LABELS[g])
            if value.endswith(":") and frame[at : at + 1] == ":":
                value = value[:-1]
        elif g in CATEGORY:
            value = {"P": f.person, "E": f.email, "T": f.phone, "I": lambda: f.identity(label), "A": lambda: f.address(lang)}[g]()
            spans.append((len(text), len(text) + len(value), CATEGORY[g]))
        elif g == "W":
            value = f.r.choice(WORD) if f.r.random() < 0.6 else f.r.choice(FIRST) if f.r.random() < 0.4 else f.r.choice(STEM) + f.r.choice(TAIL)
        elif g == "C":
            value = f.place()
        elif g == "S":
            value = f.r.choice(SENTENCES)
            if not text.strip() or text.rstrip()[-1] in ".!?…" or text[-1] == "\n":
                value = value[0].upper() + value[1:] if f.r.random() < 0.7 else value
        elif g[0] == "U":
            value = f.upper(int(g[1:]))
        else:
            value = f.digits(int(g[1:]))
        text += value
    return text + frame[at:], spans


def table(n: int = N_ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts, each with its spans ``(start, end, category)`` in code points."""
    r = random.Random(seed)
    f, rows = _Fill(r), []
    frames = [(x.replace("\\n", "\n"), True) for x in POSITIVE] + [(x, False) for x in NEGATIVE]
    positive, negative = [x for x, p in frames if p], [x for x, p in frames if not p]
    for _ in range(n):
        text, spans = "", []
        for i in range(r.choice([1, 1, 2, 2, 3])):
            piece, own = _filled(r.choice(positive if r.random() < 0.55 else negative), f)
            text += (r.choice(JOIN) if i else "") + r.choice(PREFIX)
            spans += [(a + len(text), b + len(text), c) for a, b, c in own]
            text += piece
        rows.append((text, spans))
    return rows

