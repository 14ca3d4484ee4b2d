"""Sentences labelled by hand for the test of ``pii``, written apart from its training frames.

{type|text} marks an entity. They speak of hospitals, rentals, schools, sports, courts and shops, which the
training frames don't, and hold people, streets and towns no list has.
"""

CASES = (
    "The plaintiff, {name|Alice Zimmerman}, was represented by {name|Thomas Okafor}.",
    "We met {name|Alice Zimmerman} at the dome.",
    "Nurse {name|Brigid Halloran} took the blood sample and called {phone|(617) 555-0182}.",
    "If the car is late, text {name|Dmitri} on {phone|07911 123456}.",
    "Patient: {name|Ngozi Adebayo}\nSSN: {id_number|219-09-9999}\nHome address: {address|4417 Willow Creek Lane, Boise, ID 83704}",
    "The winner of the junior cup is {name|Leopold Arnsberg}, ahead of {name|Milan Kovac}.",
    "Rent is to be paid to {name|Margaret Thistlewood}, {address|Flat 9, 27 Albion Road, Brighton BN1 4GH}.",
    "Coach {name|R. J. Fennimore} wants everybody at the pool by seven.",
    "Send the claim form to {email|claims.desk@insure-all.example} before the end of May.",
    "{name|Pedersen, Astrid} was marked absent on 14 March 2021.",
    "My mother's number hasn't changed, it is still {phone|+44 1632 960 983}.",
    "You should speak with {name|Olu} or with {name|Hamish McAllister}.",
    "His National Insurance number is {id_number|QQ 12 34 56 C}.",
    "The driver showed passport {id_number|C01234567} at the border.",
    "Reservations: {phone|1-800-555-0199}, or {email|table4two@bistro.example}",
    "jane dot doe is not an address, but {email|jane.doe [at] school [dot] example} is.",
    "Please welcome {name|Tomasz Wieczorek} and {name|Ingeborg Falk}, who start today.",
    "The Zimmerman bridge was closed for repairs.",
    "In 1998 the Okafor Prize went to a team from Lagos.",
    "Order 4471-2098 contains two kettles and one toaster.",
    "The museum in Ravenna opens at 9:30 and closes at 18:00.",
    "Our flight BA 2490 lands at 11:45 on 2023-08-17.",
    "The Fisher exact test gave p = 0.0312.",
    "Judge {name|Whitcombe} adjourned the hearing until Thursday.",
    "Dr. {name|Sunita Raghavan} operated on the knee, assisted by {name|Paul Lindqvist}.",
    "The deposit was paid by {name|Carla Montoya} (ID card {id_number|X4821093}).",
    "Badge {id_number|KT-50817} was used at the side entrance at 02:14.",
    "Lost and found: a wallet with an identity card, number {id_number|L01X00T47}.",
    "The plumber lives at {address|88 Tanner's Row, York YO1 7EP}, next to the bakery.",
    "Deliver the flowers to {address|1250 Lakeshore Drive, Apt 14, Madison, WI 53703} before noon.",
    "Old address: {address|5 Mill Lane, Ludlow}. New address: {address|61 Corve Street, Ludlow SY8 1DA}.",
    "{name|Walter Brandt}\n{address|19 Harvest Avenue,\nSpringdale 72764}\n{phone|479-555-0113}",
    "Chapter 3: Running Costs and Fuel Economy",
    "The Green Valley Choir sings at Saint Mark's Church.",
    "Water the plants every second Friday, and call the Housing Office if the pipe bursts.",
    "The class was taught by {name|Mr. Pemberton}.".replace("{name|Mr. Pemberton}", "Mr. {name|Pemberton}"),
    "Could {name|Yusuf Demir} bring the projector? {name|Yusuf} has the spare lamp too.",
    "Call the surgery on {phone|020 7946 0321 ext. 44}.",
    "For refunds write to {email|REFUNDS@SHOP-ONLINE.EXAMPLE}.",
    "{name|kim}?".replace("{name|kim}", "kim"),
    "The parents of {name|Oskar Lundgren} asked for a meeting with {name|Ms. Delacroix}.".replace("{name|Ms. Delacroix}", "Ms. {name|Delacroix}"),
    "According to {name|Fiona Gallagher}, the boiler was last serviced in 2019.",
    "Interview with {name|Abena Mensah}, goalkeeper of the year",
    "Photo: {name|Jonas Eklund}",
    "The lease names {name|H. Van Buren} as guarantor.",
    "ISBN 978-3-16-148410-0 is out of print.",
    "The serial number of the bicycle is 20340-118-77.",
    "Temperature rose from 18.25 to 21.75 degrees between 06:00 and 14:00.",
    "At 51.5072, -0.1276 the compass points to 12.4 degrees.",
    "Patch 10.4.221 breaks the login page, see issue 88231.",
    "Die Klägerin {name|Annegret Vogelsang} wohnt in der {address|Lindenstraße 44, 50674 Köln}.",
    "Bitte rufen Sie Herrn {name|Bastian Kruse} unter {phone|0221 4711 350} zurück.",
    "Frau {name|Edeltraud Maier-Lenz} hat ihren Reisepass {id_number|C4VPX8R21} vergessen.",
    "Die Turnhalle am Sportplatz bleibt bis Ostern geschlossen.",
    "Der Mietvertrag läuft auf {name|Holger Steinbach}, {address|Am Mühlbach 7a, 89073 Ulm}.",
    "Terminabsage bitte an {email|praxis@zahnarzt-nord.example} oder {phone|+49 431 9876-540}.",
    "Im Schwimmbad fehlt der Bademeister, und die Kasse ist kaputt.",
    "Zeugin ist {name|Roswitha Ebersbach}.",
    "Le médecin, {name|Solène Marchetti}, reçoit au {address|14 bis, rue des Peupliers, 69003 Lyon}.",
    "Pour réserver, appelez le {phone|04 78 55 01 23} ou écrivez à {email|accueil@hotel-des-lacs.example}.",
    "L'arbitre {name|Gaëtan Roussel} a sifflé la fin du match.",
    "Le témoin s'appelle {name|Ousmane Diallo}.",
    "La bibliothèque du quartier ferme à midi.",
    "Mme {name|Vidal} a perdu sa carte d'identité n° {id_number|12AB34567}.",
    "El entrenador, {name|Iker Zubizarreta}, vive en {address|Calle del Olmo 23, 2.º A, 28012 Madrid}.",
    "Para pedir cita llame al {phone|+34 912 345 678} o escriba a {email|citas@clinica-sur.example}.",
    "La profesora {name|Marisol Echeverría} corrigió los exámenes.",
    "Con DNI {id_number|12345678Z} se puede recoger el paquete.",
    "El museo abre todos los días menos los lunes.",
    "La carta llegó a {address|Avenida de la Paz 110, 46010 Valencia} con un mes de retraso.",
    "The hotel is in {address|Via Roma 12, 00184 Roma}.",
    "Meeting notes, 12 June: {name|Priya} to draft the letter, {name|Colm Doherty} to check the figures.",
    "reply-to: {email|no-reply+4471@parcel-tracker.example}",
    "Signed in the presence of {name|Eleanor Whitfield} and {name|J. Castellanos}",
    "Next of kin: {name|Samuel Osei}, {phone|+233 30 255 0144}",
    "All Saints School, Form 4B, has 27 pupils.",
    "The North Sea Ferry leaves from Hook of Holland at 22:00.",
    "Blood Pressure Monitor Model BP742 was returned.",
    "The Mendel laws are taught in year ten; the Hubble telescope is not.",
    "A Bernoulli trial has two outcomes.",
    "Sergeant {name|Kowalczyk} filed report 2023-00417.",
    "Ask {name|Beatriz} for the key; her extension is 417.",
)

#: Written after the model was finished, measured once and not used to change it.
FRESH = (
    "The orchestra hired {name|Valentina Moretti} as first violin.",
    "Landlord: {name|Casper Whitlow}, {address|73 Juniper Hill, Bath BA2 4QX}",
    "Please collect the glasses from {name|Ms. Oyelaran}.".replace("{name|Ms. Oyelaran}", "Ms. {name|Oyelaran}"),
    "The dentist, Dr. {name|Hugo Brennecke}, retires in June.",
    "Whoever finds the dog should ring {phone|(503) 555-0148}.",
    "The bakery on the corner closes at noon on Saturdays.",
    "{name|Gudrun} told {name|Anselm Rietz} that the boat leaks.",
    "Complaints go to {email|help@ferry-lines.example}, not to the captain.",
    "Passport {id_number|YB1234567} was found under seat 14C.",
    "The scholarship was won by {name|Thandiwe Nkosi} of Durban.",
    "The Ringwood Theatre shows three plays in autumn.",
    "Kiefer wood is soft, oak is hard.",
    "In reply to {name|L. Abernathy}, the committee raised the fee.",
    "Die Bäckerei {DUMMY|}liefert an {address|Gartenweg 18, 99084 Erfurt}.".replace("{DUMMY|}", ""),
    "Herr {name|Ottokar Wenzel} vermietet die Wohnung im dritten Stock.",
    "Das Freibad öffnet im Mai, der Eintritt kostet vier Euro.",
    "La voisine, {name|Capucine Lefort}, garde le chat.",
    "Le facteur cherche le {address|8, impasse du Lavoir, 35000 Rennes}.",
    "Le marché du samedi a lieu sur la grande place.",
    "El portero {name|Nicanor Pizarro} tiene las llaves.",
    "La reunión es en {address|Plaza del Trigo 4, 09003 Burgos}.",
    "El tren de Zaragoza llega a las ocho.",
    "Her social security number, {id_number|078-05-1120}, was on the form.",
    "Lot 4402-118 was sold for 310 euros.",
    "Notes by {name|Imogen Fairweather} and {name|Tariq Haddad}, typed by {name|Sylvie}.",
    "Reach the harbour office on {phone|+44 1326 555 018}.",
)
