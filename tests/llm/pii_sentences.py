"""Sentences written by hand, none of them made by the training grammar: ``[kind|item]`` marks what is to be found."""

SENTENCES = r"""
Please get in touch with [name|Harriet Blackwood] regarding the overdue payment.
Interview notes by [name|Emily Watson], second round.
The shipment was received by [name|Marcus Oyelaran] at the loading dock.
I spoke with [name|Priya Raghunathan] yesterday and she agreed to extend the trial.
[name|Tobias Lindgren] will be the point person for the migration.
Forward the agenda to [email|harriet.blackwood@example.com] by noon.
You can text me on [phone|(415) 555-0132] any time after five.
Her landline is [phone|020 7946 0018], the mobile is [phone|+44 7700 900123].
We moved into [address|48 Willow Crescent] three weeks ago.
The patient, [name|Gloria Mendoza], reported mild headaches.
The clerk typed [id_number|123-45-6789] is his social security number.
Passport number [id_number|X12345678] expires next spring.
He gave [id_number|078-05-1120] as her social.
The bakery at [address|12 Quarry Road] burned down.
Sie wohnt in der [address|Bahnhofstrasse 12] in Bern.
Rechnung bitte an [name|Jürgen Krause], [address|Lindenallee 7].
Notre voisine [name|Claire Fontaine] habite au [address|15 rue des Lilas].
Appelez le [phone|01 42 68 53 00] pour confirmer.
Mi hermana vive en la [address|Calle Mayor 23].
El cliente se llama [name|Rodrigo Fuentes] y su correo es [email|rodrigo.f@correo.example].
Contact person: [name|S. Okonkwo]
Meeting with [name|Hannah Kowalczyk] moved to Thursday.
We hired [name|Benjamin Achterberg] as a contractor.
[name|Olivia Chen] and [name|Samuel Wright] will review the proposal.
Attendees were [name|Nora Haddad], [name|Luis Ortega] and [name|Petra Nowak].
The lease was signed by [name|Martin J. Keller].
Yours truly, [name|Constance Eberhart]
To: [name|Wendy Abara] <[email|w.abara@post.example.org]>
Reply to [email|billing+march@shopfront.example] with the receipt.
Her new email is [email|m_rossi88@webmail.test], the old one bounces.
Tel. [phone|030 1234567], ask for the night desk.
Fax it to [phone|1-800-555-0199] please.
Call [phone|+1 212 555 0147] if the alarm goes off.
WhatsApp: [phone|+49 151 23456789]
emergency contact [name|Daniel Whitaker], phone [phone|555-867-5309]
National insurance number [id_number|QQ123456C] was rejected by the form.
Steuer-ID: [id_number|12 345 678 901]
Her taxpayer number is [id_number|98 765 432 109].
ID card no. [id_number|LK-203948-7] belongs to the tenant.
The package went to [address|221B Baker Street] instead.
Our office is located at [address|1600 Pennsylvania Avenue].
Pick me up at [address|77 Harbor Road], please.
deliver to [address|9 Mulberry Lane] before ten
She grew up at [address|340 East Cedar Street] in Ohio.
The house at [address|Kirchgasse 5] is for sale.
Die Praxis ist in der [address|Goethestraße 18].
Le colis est au [address|8, avenue Victor Hugo].
The will names [name|Eleanor Vance] as the executor.
A letter for [name|Raj Malhotra] arrived this morning.
Thanks to [name|Julia Stern] for the quick fix.
According to [name|Peter Hollins], the pump failed twice.
My neighbour [name|Agnes Tully] feeds the cat.
Professor [name|Alan Whitmore] cancelled the seminar.
Ask [name|Kenji Watanabe] for the password reset.
user full name: [name|Fatima El-Sayed]
Author: [name|Dmitri Volkov], reviewer pending.
Please remind [name|Sofia Lindholm] about the deposit.
The witness, [name|Carl Brandt], saw the truck.
We met [name|Anneke de Vries] at the conference.
Signed on behalf of [name|Theodore Maxwell].
[name|Grace Kimani] is out sick today.
[name|P. Lombardi] owes us two invoices.
Chat with [name|Yusuf Demir] went well; he prefers mornings.
Send invoices to [email|accounts@northside-clinic.example].
My address is [email|lena.hoff@studio.example.net] for anything urgent.
cc [email|j.doe@example.org], [email|k-lee@lab.example.edu]
Write to [email|jan [at] verein dot example] for tickets.
Drop the keys at [address|62 Station Road], back door.
Mobile number: [phone|0171 9876543]
The hotline [phone|0800 123 4567] is free.
She can be reached at [phone|312-555-0175] or [email|ana@bureau.example].
His social security number, [id_number|219-09-9999], leaked in the log.
The contractor [name|Oscar Dahl] parked outside [address|14 Mill Lane].
Bill [name|Ingrid Solberg], not the company.
Gespräch mit [name|Sabine Vogel] über das Budget.
Termin bei [name|Markus Ehrlich] am Dienstag.
Merci de prévenir [name|Antoine Mercier] avant midi.
La reunión con [name|Elena Vargas] fue corta.
联系人：[name|王建国]，电话 [phone|010 6552 9988]。
请联系[name|李小龙]，手机 [phone|138 0013 8000]。
The caller identified herself as [name|Miranda Prescott].
Candidate [name|Jonah Feldman] scored highest.
The keys are with [name|Bridget O'Hara] downstairs.
Return it to [name|Leonard Cho], room four.
My tax ID is [id_number|23 456 789 012], please update it.
Her passport [id_number|C98765432] was stamped twice.
The nurse called [name|Abigail Stone] at [phone|0161 496 0200].
new tenant: [name|viktor petrov], [address|31 rosewood drive]
KINDLY CALL [name|MARGARET HOLT] BEFORE FRIDAY.
The release is planned for 2024-05-01.
We upgraded to version 3.11.4 on 12.06.2023.
Invoice 20231109-44 is still open.
Meeting moved from 09:30 to 14:45 on 2025-01-17.
The server 192.168.10.24 rejected 1,204 requests.
Order 4471-882013 shipped on 03/14/2024.
It took 12,500 ms to scan 3 000 000 rows.
Build 2024.10.3 fixes issue 48213.
See chapter 7, page 142, table 3.
We ate at the Golden Dragon in New York.
The Eiffel Tower was closed on Monday.
Deutsche Bahn raised ticket prices again.
Our Data Platform team owns the Release Calendar.
Ping @marta in the channel.
The ISBN is 978-3-16-148410-0.
Commit 9f8e7d6c5b4a broke the build.
SKU 445-21-99871 is out of stock.
Machine Learning Weekly arrives every Friday.
The Grand Hotel has 204 rooms.
Temperature rose from 18.5 to 21.2 degrees.
The invoice total is $1,249.00 plus tax.
Ticket 88123 duplicates ticket 87990.
User prefers dark mode and short answers.
The phone number is missing from the form.
Please check the address field before saving.
"""


def parsed() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of each sentence."""
    import re

    out = []
    for line in SENTENCES.strip().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|phone|id_number|address|name)\|((?:[^\[\]]|\[at\])*)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out
