"""Labelled spans for the tagger of personal information, and its training.

    python -m memspark.llm.pii_train TABLES OUT.npz [STEPS [WORKERS [START.npz [RATE]]]]

The weights of the package: 3800 steps from new weights, then 2200 from those at a rate of 0.004, with 8 workers.

Texts are put together by a grammar: items of each kind in many forms, in phrases that are drawn word by word from lists
of verbs, nouns, prepositions, labels and closings in five languages, between sentences of the memories that hold neither
digits nor capitals inside. So the place of each span is known and hardly a phrase comes twice. Things that look like
items but are none (dates, versions, order numbers, amounts, places, firms, headings, handles) are labelled as such. The
bounds of the samples are parameters. Gradients are averaged over worker processes.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from memspark.llm.tagger import CODES, KINDS, PAD, encode, loss_and_gradients, new_weights, train

CARRIERS, PEOPLE = 20_000, 4_000
W = str.split

#: Words that the grammar draws from.
FIRST = W("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Paul Ashley Steven Emily Andrew Donna Kenneth Michelle Joshua Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Ronald Rebecca Timothy Laura Jason Helen Harriet Oliver Amelia Noah Freya Liam Isla Lukas Anna Maximilian Lena Jonas Hanna Felix Greta Jürgen Ingrid Wolfgang Sabine Pierre Camille Luc Chloé Antoine Élodie Hugo Manon José María Carlos Lucía Javier Carmen Diego Pilar Mateo Sofía Giulia Marco Chiara Luca Priya Rahul Ananya Arjun Wei Mei Hiroshi Yuki Kenji Sakura Fatima Omar Aisha Hassan Olga Ivan Svetlana Dmitri Agnieszka Piotr Zofia Lars Astrid Sven Linnea Femke Joost Kwame Amara Chidi Zainab Grace Victor Ruth Walter Doris Ned Tess Iris Otto")
LAST = W("Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thomas Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Nelson Baker Hall Campbell Mitchell Carter Roberts Phillips Evans Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers Morgan Cooper Reed Bailey Bell Kelly Howard Ward Watson Brooks Bennett Gray Hughes Price Blackwood Ashworth Whitfield Hawthorne Pemberton Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Bauer Krüger Dubois Lefèvre Moreau Laurent Girard Fontaine Rousseau García Fernández González Rodríguez López Martínez Sánchez Pérez Herrera Rossi Ferrari Esposito Bianchi Patel Sharma Gupta Singh Khan Nguyen Tran Kim Park Choi Tanaka Suzuki Yamamoto Nakamura Ivanov Petrova Kowalski Nowak Novák Horvat Andersson Johansson Lindqvist Jensen Hansen Visser Bakker Okafor Mensah Adeyemi Haddad Rahman Abadi O'Neill O'Brien McDonald McGregor MacLeod D'Angelo Silva Costa Pereira Santos")
GIVEN_HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建国文玉兰红梅春雪婷浩宇轩子涵梓晨欣怡佳琪"
FAMILY_HAN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹"
PARTICLES = ["van", "van der", "de", "de la", "von", "del", "di", "al", "bin", "el", "dos"]
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Miss", "Sir", "Herr", "Frau", "M.", "Mme", "Señor", "Sra.", "Rev.", "Capt."]
STREETS = W("Oak Maple Main High Church Mill Park King Queen Elm Cedar Station Victoria Lincoln Washington Sunset River Lake Hill Garden Market Bridge School Spring Willow Pine Chestnut Orchard Baker Abbey Castle Forest Meadow Rose Franklin Harbor Union Liberty Canal Kirk")
EN_ENDS = W("Street Street St. St Road Rd. Rd Avenue Ave Lane Ln Drive Dr. Boulevard Blvd Way Court Ct Place Terrace Close Crescent Square Row Parkway Gardens")
DE_ENDS = W("straße strasse str. weg gasse platz allee ring damm ufer")
NOUNS = W("notes slides keys contract invoice report minutes draft parcel letter file folder form ticket plan budget photo ticket list schedule summary laptop badge refund quote receipt agenda lease survey appointment complaint order recipe")
TASKS = W("audit rota launch migration hiring onboarding budget payroll insurance rental repair wedding exam interview booking deadline outage garden trip school tax renewal")
WHEN = ["today", "yesterday", "tomorrow", "on Monday", "by Friday", "next week", "after lunch", "before noon", "last night", "in March", "this morning", "at the office", "as usual", "if possible", "once more", "right away", "since May", "over the weekend", "two days ago", "in the evening"]
ROLES = ["manager", "landlord", "doctor", "neighbour", "client", "lawyer", "teacher", "plumber", "sister", "brother", "colleague", "tenant", "nurse", "accountant", "editor", "supervisor", "dentist", "customer", "patient", "reviewer", "contractor", "coach"]
ASK = ["ask", "call", "contact", "email", "remind", "notify", "meet", "thank", "invite", "pay", "brief", "phone", "tell", "inform", "consult", "visit", "get in touch with", "speak to", "check with", "follow up with", "write to", "hand this to", "wait for", "report to", "cc", "ping", "met", "hired", "interviewed", "emailed", "called", "saw", "talked to", "spoke to", "heard from", "sat with", "promised", "helped"]
DOES = ["will join the call", "has approved it", "left a note", "is on leave", "prefers short answers", "moved to another team", "leads the audit", "signed the lease", "wants a refund", "cannot attend", "asked for a copy", "is allergic to nuts", "called twice", "owns the boat", "wrote the draft", "agreed", "was late", "is the new lead", "takes over", "complained about the noise", "replied", "joined the company", "said no", "thinks it is fine", "needs the file", "covers the shift", "mentioned the outage", "said that the bus was late", "wrote that the room is free", "and the team met", "offered to help", "reported the bug"]
OF = ["notes by", "message from", "interview with", "call with", "lunch with", "feedback from", "slides of", "photo of", "contract with", "meeting with", "letter to", "parcel for", "gift for", "memo to", "request from", "complaint by", "review by", "written by", "signed by", "approved by", "sent by", "on behalf of", "addressed to", "according to", "assigned to", "care of", "thanks to", "together with", "reported by", "owned by", "as told by", "forwarded to", "recorded for", "goes to", "belongs to", "married to", "known as", "referred to as", "named", "called"]
NAME_LABELS = ["Name", "Full name", "name", "Patient", "Customer", "Author", "Assignee", "Sender", "Attn", "From", "To", "Witness", "Owner", "Emergency contact", "Tenant", "Driver", "Employee", "Applicant", "contact", "client", "user", "reporter", "Recipient", "Deliver to", "Guest", "Manager", "customer_name", "full_name", "holder", "Ansprechpartner", "Kunde", "Nom", "Destinataire", "Nombre", "Cliente", "Signed", "Contact person", "Dear", "Hi", "Hello", "Attention"]
MAIL_LABELS = ["email", "Email", "e-mail", "E-Mail", "mail", "Mail", "contact", "reply-to", "cc", "bcc", "to", "from", "write to", "send it to", "forward to", "courriel", "correo", "email_address", "login", "account", "reach me at", "invite", "邮箱", "questions to", "my address is", "subscribed as", "mail to", "copy to"]
PHONE_LABELS = ["phone", "Phone", "tel", "Tel.", "Tel", "mobile", "Mobile", "cell", "fax", "call", "Call", "ring", "dial", "text", "sms", "WhatsApp", "my number is", "reach me on", "call me at", "phone number", "Telefon", "Handy", "téléphone", "téléfono", "teléfono", "appeler le", "llámame al", "unter", "电话", "手机", "contact number", "Hotline", "phone_number", "number:", "or call", "office", "home", "or"]
ADDRESS_LABELS = ["lives at", "moved to", "moved from", "deliver to", "ship to", "the office at", "meet at", "visit us at", "located at", "address", "Address", "Addr.", "home address", "billing address", "street", "wohnt in der", "Adresse", "Anschrift", "habite au", "adresse :", "vive en", "vive en la", "vivo en", "die Praxis in der", "habite", "colis au", "la tienda de", "in der", "dirección", "abita in", "住在", "地址", "pick up at", "parked near", "renting", "the flat at", "a house on", "grew up at", "send it to", "return to", "the shop at", "the building at", "a fire at", "sold", "new place is", "drop it at", "between work and", "stays at", "registered at", "keys for", "left at", "in front of", "delivered to", "goes to"]
SSN = ["SSN", "Social Security number", "social security no.", "social", "SSN is", "soc sec", "social security number"]
TAX = ["tax ID", "Tax number", "TIN", "Steuer-ID", "Steuernummer", "taxpayer id", "IdNr", "tax identification number", "taxpayer number"]
PASSPORT = ["passport", "passport no.", "Passport number", "Reisepass", "passeport", "pasaporte", "travel document"]
CARD = ["ID card", "identity card", "national ID", "ID card no.", "Ausweis", "Personalausweis", "carte d'identité", "DNI", "ID number", "ID no.", "driver's license", "licence no.", "identification number"]
INSURANCE = ["NI number", "national insurance number", "NINO", "insurance number", "Versicherungsnummer", "member ID of", "health insurance no.", "NHS number", "national insurance"]
#: Forms of numbers; 9 is a digit, A a capital letter.
IDS = [(SSN, ["999-99-9999", "999 99 9999"]), (TAX, ["99 999 999 999", "99999999999", "99-9999999"]), (PASSPORT, ["A99999999", "AA9999999", "999999999", "A99A99999"]), (CARD, ["AA-999999-9", "99999999A", "A999-9999-9999", "AA999999"]), (INSURANCE, ["AA999999A", "AA 99 99 99 A", "999 999 9999", "99 999999 A 999"])]
PHONES = ["+99 9 99 99 99 99", "+99 99 99999 999", "999/99999999", "+99 (9)9999 999999", "99999 999 999", "+9 999 999 9999", "999.999.9999", "+99 99 9999 9999", "99.99.99.99.99", "+99999999999", "(999) 999-9999", "999 9999 9999", "999-999-9999", "9-999-999-9999", "99 99 99 99 99", "+99 999 9999999", "9999 999999", "(99999) 999999", "+9 (999) 999-9999", "0999 9999999", "+99-99-9999-9999", "+99 999 999 999", "999 999 999", "0999/999999", "+999 99 999 9999", "9 999 999 99 99", "09 99 99 99 99", "99999 999999"]
DOMAINS = W("example.com example.org example.net example mail.example test com org net de fr es co.uk io edu info eu nl")
PROVIDERS = W("gmail.com outlook.com yahoo.com proton.me web.de orange.fr mail.com icloud.com")
PLACES = ["New York", "San Francisco", "Los Angeles", "Hong Kong", "Cape Town", "Buenos Aires", "North Sea", "South Korea", "United Kingdom", "New Zealand", "Tel Aviv", "Rio Grande", "Lake Geneva", "Mount Fuji", "Central Park", "Times Square", "Silicon Valley", "Costa Rica", "Saudi Arabia", "Sri Lanka", "Northern Ireland", "Los Alamos", "San Diego", "Abu Dhabi", "Palo Alto", "East Berlin"]
FIRMS = ["Blue Harbor", "Silver Lake", "Northwind Traders", "Deutsche Bahn", "General Motors", "Open Library", "Red Cross", "Sunrise Bakery", "Global Logistics", "Bright Energy", "Royal Mail", "City Council", "Goldman Sachs", "Quantum Systems", "Apache Spark", "Visual Studio", "Windows Server", "Google Docs", "Machine Learning", "Data Platform", "Project Atlas", "Green Valley Foods", "Customer Success", "Human Resources", "Star Wars", "Black Friday", "Good Morning", "Happy Birthday", "Best Regards", "Kind Regards", "Memory Store", "Action Items", "Next Steps", "Open Questions", "Release Notes", "Weekly Summary", "Meeting Notes", "Key Decisions", "Root Cause", "Pull Request"]
SEPS = [": ", ": ", ": ", " ", " - ", " = ", "=", ":", "：", " is ", " – ", "\n"]
CASES = [str] * 7 + [str.lower, str.upper]


class Maker:
    def __init__(self, carriers: list[str], people: list[tuple[str, str]], seed: int = 5):
        self.r, self.carriers, self.people = random.Random(seed), carriers, people
        self.parts: list[tuple[str, str | None]] = []

    # -- items -----------------------------------------------------------------------------------------------------
    def syllables(self, low: int, high: int) -> str:
        r = self.r
        on = W("b br c cr d dw f fl g gh gr h j k l m n p pr qu r s st sk t th tw v w wr x y z bl cl pl dr ch sh sch") + ["", ""]
        vo = W("a e i o u a e i o u ia ei ee au ou")
        co = ["", "", "", *W("n r l s th nd rn ck m x b t ff lt")]
        return "".join(r.choice(on) + r.choice(vo) + r.choice(co) for _ in range(r.randint(low, high)))

    def person(self) -> tuple[str, str]:
        k = self.r.random()
        if self.people and k < 0.3:
            return self.r.choice(self.people)[0], self.r.choice(self.people)[1]
        if k < 0.65:
            return self.r.choice(FIRST), self.r.choice(LAST)
        made = lambda: self.syllables(1, 3).capitalize()
        first, last = (made() if self.r.random() < 0.7 else self.r.choice(FIRST)), (made() if self.r.random() < 0.8 else self.r.choice(LAST))
        return (first if len(first) > 2 else "Ada"), (last if len(last) > 2 else "Bering")

    def name(self) -> str:
        (first, last), r = self.person(), self.r
        letter = lambda: r.choice("ABCDEFGHIJKLMNOPRSTVW")
        form = r.choices(range(11), (40, 11, 8, 7, 10, 10, 4, 4, 4, 3, 2))[0]
        if form == 1:
            return f"{last}, {first}"
        if form == 2:
            return f"{first} {last}".lower()
        if form == 3:
            return f"{first} {last}".upper()
        if form == 4:
            return f"{letter()}. {last}"
        if form == 5:
            return f"{first} {letter()}. {last}"
        if form == 6:
            return f"{first} {self.person()[0]} {last}"
        if form == 7:
            return f"{first} {last}{r.choice(['-', ' '])}{self.person()[1]}"
        if form == 8:
            return f"{first} {r.choice(PARTICLES)} {last}"
        if form == 9:
            return f"{letter()}. {letter()}. {last}"
        if form == 10:
            return f"{last}, {first} {letter()}."[: -1 if r.random() < 0.5 else None]
        return f"{first} {last}"

    def han_name(self) -> str:
        r = self.r
        return r.choice(FAMILY_HAN) + "".join(r.choice(GIVEN_HAN) for _ in range(r.choice([1, 2, 2])))

    def fill(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPRTVWXYZ") if c == "A" else c for c in form)

    def phone(self) -> str:
        return self.fill(self.r.choice(PHONES))

    def identity(self) -> tuple[str, str]:
        labels, forms = self.r.choice(IDS)
        return self.r.choice(labels), self.fill(self.r.choice(forms))

    def address(self) -> str:
        r = self.r
        stem = r.choice([lambda: r.choice(STREETS), lambda: self.person()[1], lambda: self.syllables(1, 2).capitalize() + r.choice(W("ington ow hame stede leigh erly ham ton ford field by worth bury wick dale"))])()
        n = f"{r.choice([r.randint(1, 30), r.randint(1, 400), r.randint(1, 9999)])}{r.choice(['', '', '', '', '', '', r.choice('abcABD')])}"
        k = r.random()
        if k < 0.5:
            lead = r.choice(["", "", "", "", "North ", "South ", "East ", "West ", "N. ", "W. ", "Old "])
            out = f"{n} {lead}{stem}{r.choice(['', '', '', ' ' + r.choice(STREETS)])} {r.choice(EN_ENDS)}"
            return r.choice([str, str, str, str, str.lower, str.upper])(out)
        if k < 0.66:
            end = r.choice(DE_ENDS)
            return r.choice([f"{stem}{end} {n}", f"{stem}{end} {n}", f"{stem}-{end.capitalize()} {n}", f"{r.choice(['Am', 'An der', 'Im', 'Auf dem'])} {stem}{r.choice(['', 'berg', 'bach'])} {n}"])
        if k < 0.82:
            way = r.choice(W("rue rue avenue boulevard place chemin allée impasse quai"))
            return r.choice([f"{n}, {way} {r.choice(['', 'de ', 'du ', 'des ', 'de la '])}{stem}", f"{n} {way} {r.choice(['', 'de ', 'du ', 'de la '])}{stem}", f"{n} bis {way} {stem}"])
        way = r.choice(W("Calle Calle Avenida Plaza Paseo Via Viale Rua Avda. C/"))
        return f"{way} {r.choice(['', '', 'de ', 'de la ', 'del '])}{stem}{r.choice([' ', ' ', ', '])}{n}"

    def email(self) -> str:
        (first, last), r = self.person(), self.r
        f, l = (re.sub(r"[^a-z]", "", x.lower()) or "mia" for x in (first, last))  # noqa: E741
        n = r.randint(1, 999)
        local = r.choice([f"{f}.{l}", f"{f[0]}{l}", f"{f}{n}", f"{f}+{r.choice(['ci', 'work', 'lists', 'news', 'shop'])}", f"{l}-{f}", f"{f}_{l}{n % 99}", f"{f}_{l}", l, f"{f[0]}.{l}", r.choice(["info", "support", "sales", "billing", "office", "hr", "no-reply"]), f"{l}{n}"])
        domain = r.choice(PROVIDERS) if r.random() < 0.2 else f"{r.choice(['', '', '', 'mail.', 'corp.'])}{self.syllables(2, 4)}.{r.choice(DOMAINS)}"
        if r.random() < 0.12:
            return f"{local.replace('.', r.choice(['.', '.', '.', ' dot ']))}{r.choice([' [at] ', ' (at) ', ' AT ', ' at ', '{at}', '[at]'])}{domain.replace('.', r.choice([' dot ', ' [dot] ', '.']))}" if r.random() < 0.3 else f"{local} {r.choice(['[at]', '(at)', 'AT', 'at', '{at}'])} {domain.replace('.', ' dot ')}"
        mail = f"{local}{'@' if r.random() < 0.9 else ' @ '}{domain}"
        return mail.upper() if r.random() < 0.08 else mail

    # -- text around -----------------------------------------------------------------------------------------------
    def carrier(self) -> str:
        s, k = self.r.choice(self.carriers), self.r.random()
        return s.upper() if k < 0.04 else s.title() if k < 0.09 else s.lower() if k < 0.11 else s

    def marked(self) -> str:
        """A sentence with made-up capitalised words in places where no name is meant."""
        r, words = self.r, self.carrier().split(" ")
        for _ in range(r.choice([1, 1, 2])):
            word = self.syllables(2, 4).capitalize()
            word = r.choice([word, word, word, f"({word})", f"{word},", word.lower(), f"({word.lower()})", word.upper()])
            i = r.randrange(len(words) + 1)
            words[i : i + r.choice([0, 1])] = [word]
        s = r.choice([" ", " ", " ", " ", "  ", "\u3000", "\u00a0", "\t"]).join(words)
        k = r.random()
        if k < 0.15:
            s = f"{r.choice(['Why does', 'When does', 'How can', 'Where is', 'Does', 'What is', 'Who runs'])} {self.syllables(2, 4).capitalize()} {r.choice(['fail', 'stop', 'end', 'work', 'use it', 'so slow', 'need that'])}?"
        return s.title() if k > 0.9 else s

    def clause(self) -> str:
        s = re.sub(r"[.!?。！？:].*", "", self.carrier(), flags=re.S)
        return s[:1].lower() + s[1:]

    def put(self, *parts: str | tuple[str, str]) -> None:
        self.parts += [(p, None) if isinstance(p, str) else p for p in parts]

    def close(self) -> str:
        return self.r.choice([".", ".", ".", ".", "!", "?", "", ";", " -"])

    def item(self, kind: str) -> tuple[str, str]:
        return {"email": self.email, "phone": self.phone, "address": self.address, "name": self.name, "id_number": lambda: self.identity()[1]}[kind](), kind

    def about_name(self) -> None:
        """A name as object, subject, after a noun, beside a role, or alone after a title."""
        r, N = self.r, (self.name(), "name")
        lead = r.choice(["", "", "Please ", "please ", "We should ", "I ", "You can ", "Yesterday we ", "Do not forget to ", "They ", "user asked to ", "TODO: ", "Later she ", "- ", "* "])
        verb = r.choice(ASK)
        verb = verb[:1].upper() + verb[1:] if not lead else verb
        title = r.choice(["", "", "", r.choice(TITLES) + " "])
        tail = r.choice(["", f" {r.choice(WHEN)}", f" about the {r.choice(TASKS)}", f" for the {r.choice(NOUNS)}", f" and {self.clause()}", f", {self.clause()}", f" on the {r.choice(NOUNS)}", f" ({r.choice(ROLES)})", f" with the {r.choice(NOUNS)}", " or somebody else"])
        form = r.randrange(9)
        if form < 2:
            self.put(f"{lead}{verb} {title}", N, tail + self.close())
        elif form == 2:
            self.put(r.choice(["", "", f"{self.clause()}; ", f"{self.clause()}, ", f"{self.clause()} and ", f"The {r.choice(NOUNS)} is {r.choice(WHEN)}: ", f"{r.choice(WHEN).capitalize()} "]) + title, N, f" {r.choice(DOES)}{r.choice(['', ' ' + r.choice(WHEN), '; ' + self.clause(), ' because ' + self.clause(), ': ' + self.clause()])}{self.close()}")
        elif form == 3:
            of, det = r.choice(OF), r.choice(["", "the ", "a ", "The ", "our ", "my ", "two "])
            noun = r.choice([r.choice(NOUNS) + " ", "", self.clause() + " ", self.clause() + ", "])
            self.put(f"{det if noun else ''}{noun}{of} {title}", N, tail + self.close())
        elif form == 4:
            who = f"{r.choice(['my', 'our', 'the', 'The', 'A', 'her', 'her', 'his', 'My', 'Our', 'Their', 'The new', 'the former', 'Your'])} {r.choice(ROLES)}"
            self.put(who + r.choice([" is ", ", ", " ", " was ", ": ", " (", "'s name is ", " named ", " called "]), N, r.choice([", ", ") ", " ", "."]) + self.clause() + self.close())
        elif form == 5:
            self.put(r.choice(["Best,", "Signed,", "Signed,", "signed,", "Greetings,", "Kind regards,", "Cheers,", "Thanks,", "Yours sincerely,", "—", "/s/", "Sincerely", "Regards", "Mit freundlichen Grüßen", "Cordialement,", "Un saludo,", "Love,", "Signed by:", "Written by", "signed:"]) + r.choice(["\n", "\n\n", " ", " "]), N, r.choice(["", "\n", "\n" + r.choice(ROLES).capitalize(), "."]))
        elif form == 6:
            lead = r.choice(["Attendees: ", "Present: ", "Team: ", "With ", "Guests: ", "Ask ", "Between ", "CC: ", "authors - ", "Interviewed ", ""])
            self.put(lead, N, r.choice([", ", "; ", " and ", " & ", " / ", ", then "]), self.item("name"), r.choice([", ", " and ", "; "]) if r.random() < 0.5 else f" {r.choice(WHEN)}")
            if self.parts[-1][0][0] in ",; " and self.parts[-1][0] in (", ", " and ", "; "):
                self.put(self.item("name"))
            self.put(self.close())
        elif form == 7:
            self.put(r.choice(["my name is ", "My name is ", "I am ", "This is ", "I'm ", "call me ", "They call themselves ", "User is called ", "The user's name: ", "ich heiße ", "Mein Name ist ", "je m'appelle ", "Me llamo ", "introduced as ", "goes by ", "speaking: "]), N, tail + self.close())
        else:
            lead = r.choice(["Bitte ", "Herr Kollege ", "Termin mit ", "Brief an ", "Anruf von ", "Rendez-vous avec ", "Message de ", "Merci à ", "Reunión con ", "Carta para ", "Llamar a ", "Gespräch mit ", "Geschenk für ", "Paket an ", "Termin bei ", "Treffen mit ", "Notiz von ", "Besuch bei ", "Mein Nachbar ", "Die Kundin ", "Unser Arzt ", "El cliente se llama ", "La paciente es ", "Mi jefe ", "Mi hermana ", "Hablé con ", "Ma voisine ", "Notre médecin ", "prévenir ", "Avec ", "Elle s'appelle ", "Er heißt ", "Se llama ", "Rückruf an ", "Facture pour ", "Colis pour "])
            self.put(lead, N, r.choice([" anrufen", " fragen", " schreiben", " demain", " mañana", "", ", bitte", " por favor", " am Montag", " senden", " s'il vous plaît", " y su correo", " et sa fille", " und das Team", " über das Budget", " fue corta", " est malade", " ist krank", " avant midi", " kommt später"]) + self.close())

    def labelled(self, kind: str) -> None:
        """Label and item, in a form, a record, or a phrase."""
        r = self.r
        if kind == "id_number":
            label, number = self.identity()
            item = (number, kind)
            if r.random() < 0.2:
                self.put(r.choice(["", f"{self.clause()}: ", "He gave ", "with ", "I have ", "they sent "]), item, f" {r.choice(['as', 'is', 'was', '('])} {r.choice(['her ', 'his ', 'my ', 'the ', ''])}{label}{self.close()}")
                return
            label = r.choice(["", "", "her ", "his ", "my ", "the ", "their ", "Patient ", "with ", "new "]) + label
        else:
            labels = {"email": MAIL_LABELS, "phone": PHONE_LABELS, "address": ADDRESS_LABELS, "name": NAME_LABELS}[kind]
            label, item = r.choice(labels), self.item(kind)
        label = r.choice(CASES)(label)
        sep = r.choice(SEPS) if kind in ("name", "id_number") or r.random() < 0.4 else " "
        before = r.choice(["", "", "", f"{self.clause()}, ", f"{self.clause()} and ", "Please ", "We ", "- ", "Note: ", "* ", "She ", "(", "> "])
        if r.random() < 0.25:
            before = f"{before}{r.choice(['the ', 'a ', ''])}{r.choice(NOUNS)} "
        after = r.choice(["", f" {r.choice(WHEN)}", f", {self.clause()}", f" and {self.clause()}", f" is on the {r.choice(NOUNS)}", f" ({r.choice(['work', 'home', 'new', 'old', 'private'])})", f" in {r.choice(PLACES)}", " only", f", not the {r.choice(NOUNS)}", f"; {self.clause()}", f" was {r.choice(['lost', 'copied', 'pasted', 'checked', 'wrong', 'changed'])} {r.choice(WHEN)}", f" {r.choice(WHEN)}", r.choice([" burned down", " instead", " is for sale", ", back door", ", second floor", ", room four", " schicken", " senden", " anrufen", " please", " before ten", " rejected it", " belongs to us", " expires soon", " bounced", " rings", " a confirmar", " est perdu", " ist falsch", " was towed", " looks odd", " near the bank"])])
        self.put(before + label + sep, item, after + self.close())

    def record(self) -> None:
        """Several items together: lines, a table row, JSON, a contact card, or a sentence that joins them."""
        r = self.r
        kinds = r.sample(["name", "email", "phone", "address", "name", "email", "phone"], r.randint(2, 4))
        items = [self.item(k) for k in kinds]
        form = r.randrange(6)
        if form == 0:
            labels = {"name": NAME_LABELS, "email": MAIL_LABELS, "phone": PHONE_LABELS, "address": ["address", "street", "Adresse"]}
            q, colon, sep, (a, b) = r.choice([('"', ": ", ", ", "{}"), ('"', ":", ",", "{}"), ("'", ": ", ", ", "{}"), ("", "=", " ", ("", "")), ("", "=", "&", ("", "")), ("", ": ", "; ", ("", "")), ("", ": ", "\n", ("", ""))])
            self.put(a)
            for i, (k, item) in enumerate(zip(kinds, items)):
                label = r.choice(labels[k]).lower()
                self.put((sep if i else "") + q + label + q + colon + q, item, q)
            self.put(b)
        elif form == 1:
            sep = r.choice([", ", "; ", " | ", "\t", "\n", " / ", ",", " · "])
            self.put(r.choice(["", "", f"{r.choice(NAME_LABELS)}: ", "| ", f"{r.randint(1, 99)}. "]))
            for i, item in enumerate(items):
                self.put(sep if i else "", item)
        elif form == 2:
            self.put(r.choice(["", "Contact ", "Write to ", "To: ", "From: ", "Invite "]), self.item("name"), r.choice([" <", " (", " ["]), self.item(r.choice(["email", "email", "phone"])), r.choice([">", ")", "]"]) + r.choice(["", ", " + self.clause(), "."]))
        elif form == 3:
            self.put(r.choice(["Get hold of ", "You find ", "Call ", "Talk to ", "", "Please reach out to "]), self.item("name"), r.choice([" at ", " on ", " via ", ", ", " under ", ": "]), self.item(r.choice(["email", "phone", "phone"])), r.choice([" or ", " and ", ", or ", " / ", " / mail ", " or mail ", ", email ", "; e-mail ", " or call ", " / tel "]), self.item(r.choice(["email", "phone"])), self.close())
        elif form == 4:
            self.put(r.choice(["Send the parcel to ", "Delivery for ", "Bill to ", "Envoyer à ", "Lieferung an ", "Enviar a ", "An: ", "The tenant ", "Keys from "]), self.item("name"), r.choice([", ", " at ", "\n", ", ", " in "]), self.item("address"), r.choice(["", "; call ", ", ring ", "\n", " - tel. "]))
            if self.parts[-1][0]:
                self.put(self.item("phone"))
            self.put(self.close())
        elif r.random() < 0.5:
            self.put(r.choice(["请联系", "请转告", "通知", "我叫", "他叫", "经理", "给", "找", "客户是", "由", "和", "医生"]), (self.han_name(), "name"), r.choice(["，", "的", "在办公室", "说", "先生", "明天来", "，手机", "开会", "负责", "。"]), self.item("phone") if r.random() < 0.4 else "", r.choice(["。", "，谢谢。", ""]))
        else:
            self.put("联系" + r.choice(["人：", " ", "："]) if r.random() < 0.5 else r.choice(["姓名：", "请找", "客户", "收件人："]), (self.han_name() if r.random() < 0.6 else self.name(), "name"), r.choice(["，电话", "，手机号", "（", "，"]) + r.choice(["", " ", "："]), self.item(r.choice(["phone", "email"])), r.choice(["。", "，谢谢。", "）。"]))

    def decoy(self) -> None:
        """What resembles an item and is none."""
        r, word = self.r, self.syllables(2, 4)
        date = r.choice([f"20{self.fill('99')}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{self.fill('99')}", f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/20{self.fill('99')}", f"{r.randint(1, 28)} {r.choice(W('January March May July October'))} 20{self.fill('99')}", f"{r.choice(W('April June August'))} {r.randint(1, 28)}, 20{self.fill('99')}"])
        clock = f"{r.randint(0, 23):02}:{r.randint(0, 59):02}" + r.choice(["", f":{r.randint(0, 59):02}"])
        number = self.fill(r.choice(["9", "99", "999", "9999", "9,999", "99 999", "9.9", "99.99", "9 999 999", "999999", "99 999 999", "9999999999", "0.999", "0.9999999", "-99.9999", "9e-9"]))
        version = self.fill(r.choice(["9.9", "9.9.9", "v9.99", "99.9.9", "9.9.9-rc9", "99.99.9.99", "v99", "9.9.99.999"]))
        code = self.fill(r.choice(["9999-999999", "AA-9999", "999-99-99999", "AAA-999", "99999-99", "A9-99", "999999", "AAA99999", "#9999", "AA99-9999-99", "99-9999-A", "978-9-99-999999-9", "9999-9999-9999-9999"]))
        cap = lambda: self.syllables(2, 4).capitalize()
        two = r.choice([r.choice(PLACES), r.choice(FIRMS), f"{cap()} {r.choice(['Inc.', 'GmbH', 'Ltd', 'Corp', 'Labs', 'Systems', 'University', 'Airport', 'Bank', 'Hotel', 'Street', 'Bridge', 'Festival', 'Foundation', 'Project'])}", f"The {cap()}", f"{r.choice(['Monday', 'Friday', 'Spring', 'Winter', 'March'])} {r.choice(['Review', 'Market', 'Sale', 'Morning', 'Release', 'Standup'])}"])
        one = r.choice([cap(), r.choice(FIRST), cap()])
        thing = r.choice(["Order", "order", "Ticket", "ticket", "SKU", "Invoice", "invoice no.", "Case", "issue", "Tracking", "Ref.", "Batch", "Model", "item", "Room", "Flight", "PR", "Commit", "Build", "Job", "Serial", "part number", "ISBN", "Task", "row", "port", "line", "code"])
        forms = [
            lambda: f"{thing}{r.choice([' ', ' ', ': ', ' #', '='])}{code} {r.choice(['was split', 'is late', 'duplicates the other one', 'restocked', 'failed', 'shipped', 'is open', 'closed'])}.",
            lambda: f"{r.choice(['On', 'Since', 'Due', 'Log at', 'Updated', 'Meeting on', 'born', 'from', 'until', 'Released'])} {date}{r.choice(['', ' ' + clock, ' at ' + clock, 'T' + clock + 'Z'])} {self.clause()}.",
            lambda: f"{date} {r.choice(['to', '-', 'until'])} {date}: {self.clause()}", lambda: f"[{date} {clock}] {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} {self.clause()}", lambda: f"{date} {self.clause()} {date}.",
            lambda: f"{r.choice(['Version', 'Upgraded to', 'Pinned', 'Needs', 'python', 'release', 'Build', 'build'])} {version} {r.choice(['is live', 'broke it', 'works', 'and later', 'on staging'])}.",
            lambda: f"{r.choice(['Limit raised to', 'About', 'Counted', 'Costs', 'We sold', 'It took', 'Only', 'Wrote', 'The limit is', 'Raised from'])} {number} {r.choice(['rows', 'euros', 'ms', 'items', 'files', 'percent', 'times', 'tokens', 'users', 'GB', 'km'])}{r.choice(['', f' of {number}', f' in {number} seconds'])}.",
            lambda: f"{r.choice(['Ping', 'Thanks', 'cc', 'Ask', 'by', 'Follow', 'ping'])} @{word}{r.choice(['', '/core', '-team', '_' + word])} {r.choice(['in the channel', 'please', 'about it', ''])}.", lambda: f"Pinned @{word}/{r.choice(['core', 'ui', 'cli'])}@{version.lstrip('v')}.", lambda: f"npm i {word}@{version.lstrip('v')}",
            lambda: f"{r.choice(['We went to', 'Flight to', 'Moved from', 'The office in', 'Customers in', 'A tour of', 'News from', 'Works for', 'A talk at', 'Signed with', 'Uses', 'Bought from', 'Partners with', 'See', 'Based in', 'on', 'at', 'Watch', 'Reading', 'The', 'Invoice from'])} {two}{r.choice(['', ' ' + r.choice(WHEN), ' and ' + one, ' with ' + self.clause()])}.",
            lambda: f"{two} {r.choice(['opened', 'was closed', 'is crowded', 'raised prices', 'released a new model', 'announced it', 'comes first', 'said no', 'is down'])} {r.choice(WHEN)}.",
            lambda: f"{one} {r.choice(['said', 'wrote', 'asked', 'thinks', 'agreed:', '->', 'is', 'and'])} {self.clause()}.", lambda: f"{r.choice(['Thanks', 'Hi', 'Dear', 'Hello', 'Ask', 'for', 'With', 'on', 'near', 'See', 'in', 'Met'])} {one}, {self.clause()}.",
            lambda: f"{r.choice(['See', 'Compare', 'From', 'Between'])} {cap()}, {cap()} and {cap()}.", lambda: f"Ran {r.randint(2, 99)} {cap()} {r.choice(['streams', 'jobs', 'shards', 'tests', 'rows'])} overnight.", lambda: f"{cap()} {version}: {self.carrier()}",
            lambda: f"{r.randint(2, 99)} {r.choice(['new', 'old', 'green', 'Large', 'quick', 'broken'])} {r.choice(NOUNS)} {r.choice(WHEN)}.", lambda: f"{r.randint(1, 9)} of {r.randint(10, 40)} {r.choice(NOUNS)}, page {r.randint(1, 400)}, chapter {r.randint(1, 20)}.",
            lambda: "; ".join(f"{self.syllables(2, 3)}: {self.syllables(2, 3)} {self.fill('99')}" for _ in range(r.randint(2, 4))), lambda: f"$ {word} --{self.syllables(2, 2)} {self.syllables(2, 3)} --tier core --since {self.fill('99')}d\n{r.choice(['ok', 'done', 'failed'])} ({self.fill('9999')} rows)",
            lambda: f'{{"{self.syllables(1, 3)}": "{word}", "limit": {self.fill("999")}, "ratio": 0.{self.fill("999")}}}', lambda: f"{word}={self.syllables(1, 2)} {r.choice(['took', 'retry', 'size'])}={number}ms {self.syllables(1, 2)}={self.fill('99')}",
            lambda: f"{r.choice(['Commit', 'sha', 'hash', 'digest', 'id', 'token'])} {''.join(r.choice('0123456789abcdef') for _ in range(r.choice([7, 12, 32, 40])))} {self.clause()}", lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.randint(40, 160))),
            lambda: f"{''.join(r.choice('0123456789abcdef') for _ in range(8))}-{self.fill('9999')}-4{self.fill('99')}a-b{self.fill('999')}-{''.join(r.choice('0123456789abcdef') for _ in range(12))}",
            lambda: f"def {word}_{self.syllables(1, 2)}({self.syllables(1, 2)}, limit={self.fill('999')}):\n    return [x for x in {word} if x['{self.syllables(1, 2)}'] != {self.fill('9')}]", lambda: f"{r.choice(['http://', 'https://', 's3://', '/var/', 'C:\\\\'])}{word}.{r.choice(['example', 'test', 'internal', 'io'])}/{self.syllables(2, 3)}/{self.fill('999')}",
            lambda: f"{r.choice(['User', 'Assistant', 'Human', 'Agent', 'me', 'bot', 'Q', 'A', 'System'])}: {self.carrier()}", lambda: f"{r.choice(['## ', '# ', '### '])}{r.choice(FIRMS[-16:])}\n- {self.carrier()}", lambda: f"**{r.choice(FIRMS)}** {self.carrier()}",
            *[self.marked] * 5,
            lambda: f"{r.choice(['Order', 'order', 'Invoice', 'Ref.', 'Parcel'])} {self.fill(r.choice(['9999-999999', '999999-9999', '9999-99999']))} {r.choice(['was split', 'was late', 'is paid', 'arrived'])}.",
            lambda: f"{r.choice(['Commit', 'commit', 'Revision'])} {''.join(r.choice('0123456789abcdef') for _ in range(12))} on {cap()}{r.choice(['', ' Server', ' main'])}.",
            lambda: f"{r.choice(['IP', 'host', 'node', 'server', 'from', 'Port'])} {self.fill(r.choice(['99.99.9.99', '199.199.9.9', '9999', 'node-99.internal', '127.0.0.1:9999']))} {r.choice(['is closed', 'timed out', 'answers'])}.",
            lambda: f"{r.choice(['at', 'around', 'before', 'from'])} {clock} {r.choice(['', 'UTC', 'am', 'sharp'])} {self.clause()}.", lambda: f"{r.choice(['€', '$', '£'])}{number} {r.choice(['for', 'per', 'off'])} {self.clause()}.", self.fields, self.fields, self.fields,
            lambda: f"{r.choice(['', 'Our ', 'The '])}{r.choice(ROLES)} {r.choice(DOES)}, {self.clause()}.", lambda: f"{r.choice(ASK).capitalize()} {r.choice(['the', 'our', 'my', 'a'])} {r.choice(ROLES)} about the {r.choice(TASKS)} {r.choice(WHEN)}.",
            lambda: f"{r.choice(['the', 'our', 'The', 'old'])} {r.choice(['email', 'phone', 'address', 'name', 'street', 'number', 'passport', 'mail', 'contact'])} {r.choice(['is missing', 'was changed', 'should be checked', 'field is empty', 'list is long'])} {r.choice(WHEN)}.", lambda: f"{r.choice(OF)} {r.choice(['the', 'our', 'a', 'another'])} {r.choice(['team', 'group', *ROLES])}, {self.clause()}.",
        ]
        self.put(r.choice(forms)())

    def fields(self) -> str:
        """Name-value fields without personal information, in one of several notations and letter cases."""
        r = self.r
        names = ["owner", "reviewer", "status", "budget", "next", "due", "stage", "risk", "target", "channel", "build", "window", "region", "assignee", "team", "group", "code", "backlog", "priority", "store", "color", "size", "user group", "region code"]
        words = lambda: re.findall(r"[^\W\d_]{3,}", self.carrier().lower()) or ["note"]
        word = lambda: self.syllables(2, 4) if r.random() < 0.3 else r.choice(words())
        rows = [(r.choice(names), " ".join(word() for _ in range(r.randint(1, 3))) + r.choice([f" {r.randint(0, 99)}", f" {r.randint(0, 99)}", ""])) for _ in range(r.randint(2, 6))]
        case = r.choice([str, str, str.upper, str.capitalize, str.title])
        rows = [(case(a), r.choice([str, str, str, str.upper, str.capitalize])(b)) for a, b in rows]
        k = r.random()
        if k < 0.3:
            inner = ", ".join(f'"{a}": "{b}"' for a, b in rows)
            return "{" + inner + "}" if k < 0.2 else "{\n " + inner.replace(", ", ",\n ") + "\n}"
        colon, sep = r.choice([(": ", "; "), (" : ", "\r\n"), (": ", "\n"), (":", ";"), (": ", " | "), ("=", " "), (" -> ", ", ")])
        return sep.join(a + colon + b for a, b in rows)

    # -- examples --------------------------------------------------------------------------------------------------
    def example(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and tags of one text of at most ``most`` characters."""
        self.parts = []
        r = self.r
        for _ in range(r.randint(1, 4)):
            if self.parts:
                self.put(r.choice([" ", " ", " ", "\n", "\n\n"]))
            k = r.random()
            if k < 0.20:
                self.about_name()
            elif k < 0.44:
                self.labelled(r.choice(["email", "phone", "phone", "id_number", "id_number", "address", "address", "name"]))
            elif k < 0.54:
                self.record()
            elif k < 0.76:
                self.decoy()
            else:
                self.put(self.carrier())
        k = r.random()
        if k < 0.05:
            self.parts = [((p.upper() if k < 0.025 else p.lower()), kind) for p, kind in self.parts]
        if r.random() < 0.1:
            self.parts.insert(0, (r.choice(["✅ ", "📌 ", "Note — ", "Remember: ", "FYI ", "> ", "• "]), None))
        text = "".join(p for p, _ in self.parts)
        tags, at = np.zeros(len(text), np.int64), 0
        for p, kind in self.parts:
            if kind and p:
                b = 1 + 2 * KINDS.index(kind)
                tags[at], tags[at + 1 : at + len(p)] = b, b + 1
            at += len(p)
        a = r.randint(0, max(0, len(text) - most))
        tags = tags[a : a + most]
        # a window may begin inside a span: its rest is then a span of its own
        if len(tags) and tags[0] and tags[0] % 2 == 0:
            tags[0] -= 1
        return encode(text)[a : a + most], tags

    def batches(self, count: int, size: int = 96, most: int = 200):
        for _ in range(count):
            rows = [self.example(most) for _ in range(size)]
            t = max(len(c) for c, _ in rows)
            codes, tags, mask = np.full((t, size), PAD, np.int64), np.zeros((t, size), np.int64), np.zeros((t, size), bool)
            for j, (c, g) in enumerate(rows):
                codes[: len(c), j], tags[: len(c), j], mask[: len(c), j] = c, g, True
            yield codes, tags, mask


def samples(tables: str, carriers: int = CARRIERS, people: int = PEOPLE) -> tuple[list[str], list[tuple[str, str]]]:
    """Sentences of the memories and people of the triples, the first of each in order of their hashes. A sentence with
    a digit, an at sign, or a capital after its first word may hold an item of unknown place and carries nothing."""
    import glob
    import hashlib

    import pyarrow.parquet as pq

    read = lambda t, c: [x for f in sorted(glob.glob(f"{tables}/{t}.parquet")) for x in pq.read_table(f, columns=[c])[c].to_pylist()]
    order = lambda xs: sorted(xs, key=lambda s: hashlib.blake2b(s.encode()).digest())
    sentences = {s.strip() for t in read("memories", "text") if t and len(t) < 4000 for s in re.split(r"(?<=[.!?。！？])\s+|\n", t)}
    unsure = re.compile(r"[\d@=<>：:]|\w\W+[A-Z]|name|address|owner|contact|introduce|联系")
    german = re.compile(r"\b(?:der|die|das|und|ist|ein|eine|den)\b")
    sentences = [s for s in order(sentences) if 12 < len(s) < 220 and (not unsure.search(s) or (german.search(s) and not re.search(r"[\d@=<>：:]|\bBitte\b|schicken|Adresse", s)))][:carriers]
    names = {tuple(x.split()) for x in read("kg_triples", "subject") if x and re.fullmatch(r"[A-Z][a-z]+ [A-Z][a-z]+", x)}
    return sentences, [(a, b) for a, b in sorted(names)][:people]


_own: list = []


def _begin(carriers: list[str], people: list[tuple[str, str]], size: int) -> None:
    import os

    _own.append(Maker(carriers, people, seed=os.getpid()).batches(1 << 40, size))


def _step(w: dict) -> tuple[float, dict]:
    return loss_and_gradients(w, *next(_own[0]))


def main(tables: str, out: str, steps: int = 3800, workers: int = 8, start: str = "", rate: float = 8e-3, size: int = 24) -> None:
    import multiprocessing
    import os
    import time

    # a worker is one thread: its matrices are small
    os.environ |= {k: "1" for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}
    assert CODES < 256
    carriers, people = samples(tables)
    print(len(carriers), "carriers,", len(people), "people", flush=True)
    losses, began = [], time.time()
    with multiprocessing.get_context("spawn").Pool(workers, _begin, (carriers, people, size)) as pool:

        def gradients(w: dict) -> tuple[float, dict]:
            got = pool.map(_step, [w] * workers, chunksize=1)
            return float(np.mean([x for x, _ in got])), {k: sum(g[k] for _, g in got) / workers for k in w}

        def report(step: int, loss: float) -> None:
            losses.append(loss)
            if step % 100 == 0:
                print(step, round(float(np.mean(losses[-100:])), 4), round(time.time() - began), "s", flush=True)

        w = new_weights()
        if start:
            with np.load(start) as f:
                w = {k: f[k] for k in f.files}
        w = train(w, steps, gradients, rate=rate, report=report)
    np.savez_compressed(out, **{k: v.astype(np.float32) for k, v in w.items()})


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *(kind(x) for kind, x in zip((int, int, str, float), sys.argv[3:])))
