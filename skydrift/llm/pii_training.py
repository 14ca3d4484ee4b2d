"""Labelled texts for the segment model of ``pii``, generated from a seed.

Frames and words were written for this purpose, from general knowledge: everyday office,
travel, delivery, club and laboratory prose in four languages, some with slots for entities, some in
which names, numbers and places stand for other things. No text of a corpus was copied or looked at for them, but they are not
wholly independent of the test documents: their writers knew frames of an older version that stood in these, and general
forms of numbers, mail-like strings, catalogue names and German nouns that are no personal data were added after the
finds of the new model in sf0.01 had been counted, by shape and context class, against those of the older one. Numbers and addresses follow the forms
that are public in their countries (with random digits). People are drawn from the staff list,
from widespread names, or are invented, so that the model leans on no list alone.
"""

from __future__ import annotations

import random

from skydrift.llm.pii import GIVEN, Lexicon

# frames: {name} {email} {phone} {address} {id} are entities, {lab} a label for the identity number after it
EN = (
    "{name} booked the seminar room for Tuesday.", "I spoke to {name} about the budget.", "Thanks to {name} for the photographs.", "The keys are with {name}.", "{name} will be back on Monday.", "We thank {name} and {name} for their help.",
    "According to {name} the pump was replaced.", "Please ask {name} before you sign anything.", "This was first noticed by {name}.", "Minutes taken by {name}.", "{name} joined as the new technician.", "{name}, {name} and {name} were present.",
    "{ttl} {name} has approved the order.", "The talk by {ttl} {name} starts at ten.", "Dear {name},", "Dear {ttl} {name},", "Hi {name},", "Best regards, {name}", "Yours sincerely,\n{name}", "Many thanks\n{name}", "Author: {name}", "Reviewed by {name} on Friday",
    "From: {name}", "{name} said the shipment was late.", "as {name} pointed out, the invoice is wrong", "{name}'s laptop is broken.", "My colleague {name} can show you around.", "ask {name} or {name}, they know", "assigned to {name}", "{name} wrote:",
    "{name} and I checked the list twice.", "I have not heard from {name} since the meeting.", "Nobody except {name} has access.", "The proposal of {name} was accepted.", "{name} is on leave; {name} stands in.", "Passengers: {name}, {name}",
    "Phone {phone} after six.", "Our number is {phone}.", "Fax: {phone}", "Tel.: {phone}", "You may call me at {phone} or write to {email}.", "For urgent matters dial {phone}.", "{name} can be reached on {phone}.", "mobile {phone}, office {phone}", "Ring {phone} and ask for {name}.",
    "the front desk ({phone}) is closed on Sundays", "Text me on {phone}", "Emergency contact: {name}, {phone}", "Call back on {phone}.", "{phone}", "Please send it to {email}.", "My address is {email}.", "Questions? {email}", "E-mail: {email}", "To unsubscribe, write to {email}.",
    "{name} <{email}>", "{name} ({email})", "{email} or {phone}", "forward it to {email} and {email}", "reply to {email} by Friday", "Our accounts team ({email}) will answer.", "{lab} {id}", "{lab}: {id}", "Her {lab} is {id}.", "the {lab} ({id}) has expired", "His {lab} {id} was copied at the desk.",
    "I lost my {lab}, {id}.", "Please quote {lab} {id} at the gate.", "{name}, {lab} {id}, is allowed in.", "We registered {name} with {lab} {id}.", "Enter with {lab} {id} only.", "Ship it to {address}.", "Our office has moved to {address}.", "He lives at {address}.", "Delivery address: {address}",
    "the courier went to {address} instead", "We stayed at {address} for two nights.", "Visit us: {address}.", "{name}, {address}", "{name}\n{address}", "Bill to {name}, {address}.", "The spare part was left at {address} with {name}.", "Return to: {address}", "Meet me at {address} at noon.",
    "{name}, {address}, {phone}", "Home: {address}; mobile: {phone}", "Applicant: {name}; {lab}: {id}; phone: {phone}; e-mail: {email}", "{name} | {email} | {phone}", "Sender {name}, {address}, {email}", "{name} lost the bet to {name} at {place}.", "In {place}, {name} opened the workshop.",
    "Yesterday {name} drove from {place} to {place}.", "{name} of {place} won the raffle.", "{name} ({place})", "Signed: {name}, {place}", "Cheers,\n{name}\n{phone}", "-- \n{name}\n{address}\n{email}", "Kind regards\n{name}\n{email}\n{phone}",
)
DE = (
    "{name} hat den Raum reserviert.", "Ich habe mit {name} gesprochen.", "{dttl} {name} kommt erst am Montag.", "Sehr geehrte {dttl} {name},", "Sehr geehrter {dttl} {name},", "Liebe {name},", "Hallo {name},", "Viele Grüße\n{name}", "Mit freundlichen Grüßen\n{name}",
    "Die Schlüssel liegen bei {name}.", "{name} und {name} waren anwesend.", "Fragen beantwortet {dttl} {name}.", "Laut {name} ist die Pumpe defekt.", "Protokoll: {name}", "Bestellt von {name} am Freitag.", "Vielen Dank an {name} für die Fotos.", "Das Gerät wurde von {name} geprüft.", "Nach Auskunft von {dttl} {name} ist alles fertig.",
    "Telefon: {phone}", "Sie erreichen uns unter {phone}.", "Rufen Sie bitte {phone} an.", "Handy {phone}, Büro {phone}", "Bitte an {email} schicken.", "E-Mail an {email} genügt.", "Kontakt: {name}, {email}", "Lieferung an {name}, {address}.", "Wir sind umgezogen: {address}.", "Er wohnt {address}.", "Adresse: {address}",
    "Rechnung an {address}", "Absender: {name}, {address}", "{dlab} {id}", "{dlab}: {id}", "Die {dlab} lautet {id}.", "{name} zeigte {dlab} {id} vor.", "{name}, {address}, Tel. {phone}", "Der Brief an {address} kam zurück.", "{name} ist im Urlaub, Vertretung: {name}", "Gast: {name}, {dlab} {id}",
)
FR = (
    "{name} a réservé la salle.", "J'ai parlé avec {name} hier.", "{fttl} {name} arrive lundi.", "Chère {name},", "Cher {fttl} {name},", "Bonjour {name},", "Cordialement,\n{name}", "Bien à vous\n{name}", "Les clés sont chez {name}.", "{name} et {name} étaient présents.", "D'après {name}, la pompe est en panne.",
    "Merci à {name} pour les photos.", "Le rapport de {fttl} {name} est prêt.", "Demandez à {name} avant de signer.", "Compte rendu : {name}", "Commande passée par {name} vendredi.", "Téléphone : {phone}", "Joignez-nous au {phone}.", "Vous pouvez appeler le {phone}.", "portable {phone}, bureau {phone}",
    "Envoyez-le à {email}.", "Courriel : {email}", "Contact : {name}, {email}", "Livraison chez {name}, {address}.", "Nous avons déménagé : {address}.", "Il habite {address}.", "Adresse : {address}", "Facture à envoyer au {address}.", "{flab} {id}", "{flab} : {id}", "Son {flab} est le {id}.", "{name} a montré {flab} {id}.",
    "Expéditeur : {name}, {address}", "Le colis pour {address} est revenu.", "{name}, {address}, tél. {phone}", "Selon {fttl} {name}, tout est prêt.", "{name} remplace {name} cette semaine.",
)
ES = (
    "{name} reservó la sala.", "Ayer hablé con {name}.", "{ettl} {name} llega el lunes.", "Estimada {name}:", "Estimado {ettl} {name}:", "Hola, {name}:", "Un saludo,\n{name}", "Atentamente\n{name}", "Las llaves las tiene {name}.", "Asistieron {name} y {name}.", "Según {name} la bomba está rota.",
    "Gracias a {name} por las fotos.", "El informe de {ettl} {name} está listo.", "Pregunte a {name} antes de firmar.", "Acta: {name}", "Pedido de {name} del viernes.", "Teléfono: {phone}", "Puede llamarnos al {phone}.", "Llame al {phone} por la tarde.", "móvil {phone}, oficina {phone}", "Envíelo a {email}.",
    "Correo: {email}", "Contacto: {name}, {email}", "Entrega a {name}, {address}.", "Nos hemos mudado: {address}.", "Vive en {address}.", "Dirección: {address}", "La factura va a {address}.", "{elab} {id}", "{elab}: {id}", "Su {elab} es {id}.", "{name} presentó {elab} {id}.", "Remitente: {name}, {address}",
    "El paquete para {address} ha vuelto.", "{name}, {address}, tel. {phone}", "{name} sustituye a {name} esta semana.",
)
# more people, with {role} and {verb} from the lists below
EN += (
    "{Role} {name} {did} the {noun}.", "The {role}, {name}, {did} it.", "the {role} {name} {did} a {noun}", "{name}, the {role}, {did} the {noun}.", "{name} {did} the {noun} in {place}.", "{name} {did} and {name} {did}.", "We {did} {name} about the {noun}.", "they {did} {name} and {name}", "I {did} it for {name}.",
    "The {noun} of {name} is {adj}.", "The {noun} was {did} by {name}.", "A {noun} from {name}, {did} at {d2}:{d2}", "Our {role} is {name}.", "my {role} {name}", "{name} has the {noun}.", "Is {name} in? {name} {did} the {noun}.", "Could {name} bring the {noun}?", "{Noun}: {name}", "{name} to check the {noun}", "with {name} as {role}",
    "{name} is the {role} of the {place} {noun}.", "between {name} and {name}", "{name} ({d2}) is a {role}.", "{Noun} by {name}, {Noun} by {name}", "the parents of {name}", "{name}, {role}", "{name} - {role}", "in the presence of {name}", "{adj} {noun} for {name}", "Even {name} {did} it.",
)
DE += (
    "{drole} {name} {ddid} den {DNoun}.", "Der {drole} {name} {ddid} die {DNoun}.", "Die {drole}in {name} {ddid} das {DNoun}.", "Unser {drole} ist {name}.", "{name} {ddid} den {DNoun} in {place}.", "Der {DNoun} von {name} ist fertig.", "Mit {name} und {name} im {DNoun}.", "Die {drole}in heißt {name}.", "{name}, {drole}", "für {name} am {DNoun}", "{DNoun}: {name}", "Zusammen mit {name} {ddid} er den {DNoun}.",
)
FR += (
    "Le {frole} {name} {fdid} le {fnoun}.", "La {frole}, {name}, {fdid} la {fnoun}.", "Notre {frole} est {name}.", "{name} {fdid} le {fnoun} à {place}.", "Le {fnoun} de {name} est prêt.", "avec {name} et {name}", "Le {frole} s'appelle {name}.", "{name}, {frole}", "pour {name}", "{fnoun} : {name}",
)
ES += (
    "El {erole} {name} {edid} el {enoun}.", "La {erole}, {name}, {edid} la {enoun}.", "Nuestro {erole} es {name}.", "{name} {edid} el {enoun} en {place}.", "El {enoun} de {name} está listo.", "con {name} y {name}", "El {erole} se llama {name}.", "{name}, {erole}", "para {name}", "{enoun}: {name}",
)
# frames without entities; {fam} and {giv} are family and given names that stand for no person
PLAIN = (
    "The {fam} {thing} was applied to both samples.", "We use the {fam} {thing} throughout.", "A {fam} {thing} would be faster.", "{fam} {Thing} is listed in the appendix.", "{fam} and {fam2} {thing}s differ in two places.", "See the {fam} {thing} for details.", "the {fam}-{fam2} {thing}", "In the {fam} {thing} the error is smaller.",
    "{giv}-{d2} is down for maintenance.", "Node {giv} ran out of memory.", "Server {giv}{d1} was rebooted.", "The ship {giv} left port.", "{giv}.{giv2} is the name of the config file.", "user_{giv} has no rights", "The {fam} Prize was awarded for chemistry.", "{fam} Street is closed.", "{fam} Hall is full.",
    "The train to {place} was late.", "{place} Observatory was closed.", "It rained in {place} and {place} all week.", "The {place} office is open.", "{place}, {d4}", "The road from {place} to {place} is icy.", "We met in {place} on Monday.", "Universität {place}", "Le laboratoire de {place} est fermé.", "El centro de {place} está cerrado.",
    "Die Straße nach {place} ist gesperrt.", "La prueba de {fam} falla.", "Le prix {fam} sera remis demain.", "La méthode de {fam} est lente.", "Das {fam}-Verfahren ist langsam.", "Der {fam}-Preis wurde vergeben.", "El método {fam} es lento.", "Der Katalog von {fam} hat {d4} Einträge.", "le catalogue {fam} compte {d4} entrées",
    "Invoice {d6} is overdue.", "Order no. {d8} was shipped on {date}.", "Ticket {d5}: disk full", "The file has {d3},{d3} lines.", "It took {d2} minutes and {d2} seconds.", "Version {d1}.{d2}.{d3} fixes the bug.", "Build {d4}-{d2}-{d2}", "See doi:10.{d4}/{d4}.{d4}.{d3} for the proof.", "ISBN {d3}-{d1}-{d3}-{d5}-{d1}", "ISSN {d4}-{d4}",
    "https://example.org/{d4}/{d2}/item{d5}.html", "Checksum {hex}{hex}", "commit {hex}", "/data/run{d3}/part-{d5}.csv", "IP 192.168.{d2}.{d2}", "Coordinates {d2}.{d4}, -{d2}.{d4}", "RA {d2} {d2} {d2}.{d1} Dec +{d2} {d2} {d2}", "T = {d9} s", "at second {d9}.{d2} of the run", "Epoch {d10}", "{d4}-{d2}-{d2} {d2}:{d2}:{d2}",
    "between {d3} {d3} and {d3} {d3}", "Part number {d3}-{d4}-{d2}", "Parcel {d5}-{d3}-{d1} has arrived.", "Tracking code {d4} {d4} {d4}", "serial {d3}-{d2}-{d4}", "runs {d3}-{d2}-{d4} and {d3}-{d2}-{d3}", "batch {d3}/{d4}/{d1}", "Room {d3}, Building {d1}", "page {d2} of {d3}", "Figure {d1} and Table {d1}", "EUR {d1}.{d3},{d2}",
    "bins {d1}-{d2}-{d2}-{d2}", "rows {d6}-{d6}", "object J{d4}.{d1}+{d4}", "source J{d4}-{d4}", "HD {d6}", "NGC {d4}", "Model XR{d4}-{d2}", "Error E{d4} in module AB{d2}", "Flight LH {d4}", "file AB{d6}.dat", "ref. {L}{d3}-{d2}/{d4}", "Artikel {d3}.{d3}.{d2}", "Rechnung Nr. {d6}", "facture n° {d6}", "factura n.º {d6}",
    "{Adj} {Noun} of the {Adj} {Noun}", "The {Adj} {Noun} Committee meets twice a year.", "{Noun} {Noun} Report", "{Adj} {Noun} and {Adj} {Noun}", "Chapter {d1}: {Adj} {Noun}", "the {Noun} {Noun} Group", "{Noun} Day is on Friday.", "Annual {Noun} Meeting", "{Adj} {Noun} Release {d1}", "Department of {Noun} {Noun}", "{Noun}: {Noun} {d2}",
    "Subject: {noun} for the {noun}", "Re: {adj} {noun}", "{Adj} {noun}s were seen again.", "No {noun} was found in the {adj} {noun}.", "Each {noun} needs a {noun}.", "How many {noun}s fit into one {adj} {noun}?", "Suppose the {noun} is {adj}; which {noun} comes first?", "Compare {d2} {noun}s with {d3} {noun}s.", "If a {noun} has {d2} {noun}s, find the {adj} one.",
    "Der {DNoun} ist im {DNoun} nicht zu finden.", "Die {DNoun} und das {DNoun} wurden am {DNoun} geprüft.", "Im {DNoun} fehlt ein {DNoun}.", "Zwischen {DNoun} und {DNoun} liegt ein {DNoun}.", "Für jeden {DNoun} gibt es eine {DNoun}.", "{DNoun}, {DNoun} und {DNoun} sind bereit.", "Neue {DNoun} für {DNoun} {d2}", "Am Ende bleibt der {DNoun}.", "Wegen {DNoun} geschlossen.",
    "Le {fnoun} est en panne depuis {d2} jours.", "La {fnoun} et le {fnoun} sont prêts.", "Chaque {fnoun} a son {fnoun}.", "El {enoun} lleva {d2} días parado.", "La {enoun} y el {enoun} están listos.", "Cada {enoun} tiene su {enoun}.", "On Monday, March {d1}, the {noun} failed.", "Since January the {noun} has been {adj}.", "The French and German {noun}s agree.",
    "Der {Made} ist im {Made}.", "Die {Made} und die {Made} fehlen.", "{Made} {d2} und {Made} {d1}", "The {Made} {noun} is {adj}.", "We installed {Made} on the {noun}.", "{Made} is {adj} today.", "with {Made} and {Made}", "{Made} {Made} {d1}", "by {Made}", "von {Made}", "zur {Made}", "mit {Made}", "Nach der {Made} {ddid} er den {DNoun}.", "{Made}: {noun}",
    "The {role} {did} the {noun}.", "A {role} from {place} {did} us.", "{Role}s and {role}s {did} the {noun}.", "Nobody {did} the {adj} {noun}.", "Every {role} has a {noun}.", "Der {drole} {ddid} den {DNoun}.", "Le {frole} {fdid} le {fnoun}.", "El {erole} {edid} el {enoun}.", "{Noun}s {did} by the {role}", "It was {did} in {place}.", "{place} {did} the {noun}.", "from {place} to {place}", "in {place} and in {place}",
    # forms of numbers, addresses and mail that are none: what they belong to tells
    "{Count} {like} was {did}.", "the {count} {like} is {adj}", "{Count}s {like} and {like} were {did}.", "{like} {count}s", "{Count} {like}: {adj} {noun}", "see {count} {like}", "from {like} to {like}", "{count} {like} of the {noun}", "{like}", "{like} {noun}s", "({like})", "Values {like}, {like}", "{Noun} {like}", "{noun}={like}",
    "{dcount} {like} ist {adj}", "Die {dcount} {like} wurde geprüft.", "la {fnoun} {like}", "n.º {like}", "el {enoun} {like}", "le {fnoun} {like}", "{maillike} is not found", "see {maillike}", "{noun} {maillike}", "{maillike}: {d2}", "cell {maillike} holds {d3} {noun}s", "install {maillike}", "@{noun}{d2} {did} it", "{d2} @ {d2}.{d2} EUR",
    "Im Jahr 20{d2} fehlt der {DNoun}.", "Am {DNoun} {d2} wurde {DNoun} geprüft.", "Im {DNoun} {d3} steht nichts.", "An der {DNoun} {d1} liegt es nicht.", "Zum {DNoun} {d2}", "Auf {DNoun} {d3} und {DNoun} {d2}", "Unter {DNoun} {d2} steht {d4}.", "{d3} {DNoun} und {d2} {DNoun}", "Es fehlen {d3} {DNoun}.", "{d4} {Made} im {DNoun} {d2}", "Nach {d2} {DNoun} war {DNoun}.",
    "{d2} {Made} {ddid} der {drole}.", "Um {d2}:{d2} {DNoun}", "{d2}:{d2} {Made} geprüft", "{DNoun} {d2} {Made}", "In {d2} {DNoun}", "Bitte {Made} prüfen.", "{Start}, the {noun} is {adj}.", "{Start} {noun}s are {adj}.", "{Start} the {noun} {did} it.", "{Start}: {noun}", "{Start} {Start} {noun}", "{DStart} {ddid} der {drole} den {DNoun}.", "{DStart} {DNoun} {d2}", "{FStart}, le {fnoun} est prêt.",
    "{FStart} {fnoun} {d2}", "{EStart}, el {enoun} está listo.", "{EStart} {enoun} {d2}", "{d2} {fnoun}s et {d3} {fnoun}s", "{d3} {enoun}s y {d2} {enoun}s", "{d2} {Noun} Road is the old name.", "Number {d2} {Made} Street is a museum", "{Made} Road {d2} is closed", "{d2} rue is not a place", "Calle {d2}", "{fam} Road {d2}", "{d2} {Made} {Kind} {noun}s were {did}.", "The {noun} has {d2} {Adj} {Kind} signs.", "{d2} {Adj} {Kind} {adj} {noun}", "{d3} {Noun} {Kind}s", "Sector {d2} {Noun} {Kind} is {adj}.", "{noun} {d2} {Made} {Kind}", "{d2} {fam} {Kind} {noun}s",
    "{desig} is {adj}.", "{desig} and {desig} were {did}", "the {noun} near {desig}", "{d1}.{d1} degrees from {desig}", "{desig}: {adj}", "Das {DNoun} bei {desig}", "la {fnoun} {desig}", "la {enoun} {desig}", "object {desig} ({d2}.{d1})", "{Noun} of {desig}", "{role} {did} {desig}", "({desig})",
    "North of {place} the {noun} is {adj}.", "Milky Way and Crab Nebula", "The Linux kernel and the Python script disagree.", "Monday: {noun}. Tuesday: {noun}.", "Please restart the {noun} before Friday.", "Check the {noun} twice.", "Use {Noun} instead of {Noun}.", "OK, the {noun} works.", "Note that {noun}s are {adj}.", "Hello all, the {noun} is {adj}.",
    "Dear all,", "Dear colleagues,", "Hi team,", "Best,", "Liebe Kollegen,", "Bonjour à tous,", "Hola a todos:", "Gracias y un saludo", "Thanks in advance", "Meeting with the {Noun} Group at ten", "Contact the {noun} desk.", "according to the {noun}", "signed by the {noun} office", "Laut {DNoun} ist alles gut.", "selon le {fnoun}", "según la {enoun}",
)
THINGS = "method test algorithm estimator theorem lemma constant catalogue catalog telescope crater bound filter transform distribution model index scale law equation machine engine detector survey prize medal bridge process bulletin inequality plot statistic correction matrix kernel score criterion chart list atlas cluster".split()
NOUNS = "report budget pump sensor cable window server schedule garden engine valve bottle paper project camera meeting folder sample signal battery station shelf panel printer mirror lamp router bridge parcel season market journal harbour forest river ladder bicycle kitchen concert lecture library museum notebook antenna record error weather safety quality data energy network team event archive map".split()
ADJS = "new old quick slow annual monthly public quiet heavy bright narrow broken second final early late digital northern central modern empty special general advanced simple steady clear average local joint open main".split()
DNOUNS = "Bericht Haushalt Pumpe Fühler Kabel Fenster Rechner Plan Garten Motor Ventil Flasche Papier Vorhaben Kamera Sitzung Ordner Probe Signal Batterie Bahnhof Regal Drucker Spiegel Lampe Brücke Paket Markt Wald Fluss Leiter Küche Vortrag Bücherei Heft Antenne Fehler Wetter Sicherheit Daten Netz Karte Woche Zeile Datei Messung Auswertung Liste Zeit Grenze Fläche Rauschen Quelle Ergebnis".split()
FNOUNS = "rapport budget capteur câble serveur jardin moteur papier projet dossier signal marché musée journal concert réseau fenêtre pompe batterie gare lampe forêt rivière carte erreur liste semaine mesure source limite".split()
ENOUNS = "informe presupuesto sensor cable servidor jardín motor papel proyecto archivo mercado museo diario concierto ventana bomba batería estación lámpara carta semana medida fuente lista red zona".split()
ROLES = "engineer doctor teacher nurse driver pilot captain coach judge lawyer sergeant officer editor author professor student technician manager director secretary chair curator witness tenant patient guest neighbour plumber painter singer player keeper cook clerk president treasurer speaker winner inspector operator analyst librarian astronomer physicist observer referee assistant colleague brother sister friend".split()
DID = "asked told called met thanked visited opened closed checked repaired wrote sent lost found saw said signed paid cleaned painted taught invited welcomed praised left joined reported moved sold bought cancelled confirmed measured noticed explained promised drew carried finished started fixed ran".split()
D_ROLES = "Lehrer Arzt Richter Fahrer Trainer Zeuge Mieter Nachbar Techniker Leiter Direktor Kollege Student Professor Pilot Kapitän Sprecher Gärtner Koch Ingenieur Beobachter Gast Freund".split()
D_DID = "prüfte fand öffnete schrieb reparierte verkaufte las bestellte traf sah holte brachte leitet sucht kennt hat".split()
F_ROLES = "médecin juge professeur voisin témoin directeur pilote capitaine technicien ingénieur gardien locataire étudiant arbitre observateur collègue".split()
F_DID = "ouvre ferme répare écrit trouve vend prépare vérifie cherche apporte signe lit dirige".split()
E_ROLES = "médico juez profesor vecino testigo director piloto capitán técnico ingeniero guardia inquilino estudiante árbitro observador colega entrenador".split()
E_DID = "abre cierra repara escribe encuentra vende prepara revisa busca trae firma lee dirige".split()
COUNTS = "order part parcel serial batch run key ticket invoice version model row item page code line block group range scale sum total checksum product article tracking shipment account entry case file sample reading sequence index record step level".split()
D_COUNTS = "Bestellung Artikelnummer Sendung Seriennummer Rechnung Zeile Datei Ausgabe Nummer Summe Folge Messung Reihe Kennung Akte Teilenummer".split()
START = "meanwhile perhaps however because although several most some many few another other yesterday today tomorrow tonight currently recently unfortunately finally next first second further moreover since while during until under over without within given using despite instead maybe also even still just only once twice never always often sometimes usually reminder note warning update question answer problem solution result summary details agenda minutes attached sorry thanks welcome hello yes okay done fixed open pending nothing something everything anyone someone everyone users staff visitors show list explain describe prove find check please restart keep remove add move write read look try make take give ask let put set run use test draw plan".split()
D_START = "heute gestern morgen leider danach dann dort hier dabei außerdem trotzdem deshalb vielleicht zuerst später inzwischen wieder nun jetzt seit während jeder jede alle einige viele mehrere kein keine nichts niemand neue neuer alter erste zweite letzte nächste frage antwort hinweis achtung bitte danke hallo erkläre zeige prüfe nenne".split()
F_START = "hier demain ensuite enfin cependant toutefois pourtant donc ainsi aussi souvent parfois jamais toujours chaque plusieurs quelques aucun aucune rien personne premier première dernier dernière question réponse attention merci bonjour expliquez montrez vérifiez trouvez".split()
E_START = "ayer hoy mañana luego después finalmente además también entonces así siempre nunca a veces cada varios algunos ningún ninguna nada nadie primero primera último última pregunta respuesta atención gracias hola explique muestre revise encuentre".split()
LABELS = "SSN|social security number|social security no.|NI number|National Insurance number|national insurance no.|NINO|passport|passport no.|passport number|ID card|identity card|identity card number|ID number|ID|staff card|staff card no.|staff ID|badge|badge no.|badge number|employee badge|driver's ID".split("|")
D_LABELS = "Ausweis|Ausweisnummer|Personalausweis|Reisepass|Passnummer|Sozialversicherungsnummer|Dienstausweis|Mitarbeiterausweis|Personalnummer".split("|")
F_LABELS = "carte d'identité|passeport|numéro de passeport|numéro de sécurité sociale|n° de sécurité sociale|badge|carte de service|carte".split("|")
E_LABELS = "DNI|NIE|pasaporte|número de pasaporte|documento de identidad|número de la seguridad social|tarjeta|tarjeta de empleado|documento".split("|")
TITLES = {"ttl": ("Mr", "Mrs", "Ms", "Mr.", "Mrs.", "Ms.", "Dr", "Dr.", "Prof.", "Professor", "Miss", "Sir"), "dttl": ("Herr", "Frau", "Herrn", "Dr.", "Frau Dr.", "Herr Dr.", "Prof. Dr."), "fttl": ("M.", "Mme", "Mlle", "Monsieur", "Madame", "Dr"), "ettl": ("Sr.", "Sra.", "el Sr.", "la Sra.", "el Dr.", "la Dra.", "don", "doña")}
FAMILY = "Smith Johnson Miller Taylor Wilson Moore Clark Walker Hall Young King Wright Green Baker Carter Turner Parker Evans Murphy Kelly Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Braun Krüger Martin Bernard Dubois Thomas Robert Petit Durand Leroy Moreau Simon Lefebvre Roux Fournier Girard Bonnet García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Moreno Álvarez Romero Navarro Torres O'Brien McDonald".split()
# street words: common ones of each country, and made ones
EN_STREET = "High Church Park Station Victoria London Green Manor Kings Queens Windsor York Grange Mill Springfield School West Main Oak Pine Maple Cedar Washington Lake Hill Lincoln Second Third Sunset Highland".split()
EN_KIND = "Road Street Lane Avenue Drive Close Crescent Row Walk Hill Way Court Place Terrace Square Gardens Grove Mews Rise View".split()
DE_STREET = "Haupt Schul Garten Bahnhof Dorf Berg Birken Linden Kirch Wald Ring Schiller Goethe Jahn Wiesen Mozart Rosen Buchen Feld Wasser".split()
DE_KIND = "straße straße strasse gasse weg allee platz ufer ring damm".split()
DE_FREE = ("Am Bahnhof", "Im Winkel", "An der Kirche", "Zum Sportplatz", "Am Alten Markt", "Auf dem Berg", "Unter den Linden")
FR_KIND = "rue avenue impasse chemin quai boulevard place allée route cours".split()
FR_STREET = ("de la République", "Victor Hugo", "du Général de Gaulle", "des Écoles", "de l'Église", "Pasteur", "Jean Jaurès", "du Château", "des Lilas", "de Paris", "Saint-Michel", "de la Mairie", "des Deux-Rives", "du Stade", "aux Herbes")
ES_KIND = ("Calle", "Avenida", "Plaza", "Camino", "Paseo", "Carretera", "C/", "Avda.")
ES_STREET = ("Mayor", "Real", "de la Constitución", "de España", "del Sol", "de la Iglesia", "San José", "de Cervantes", "de los Reyes", "del Carmen", "de Toledo", "de la Estación Vieja", "Nueva", "de las Flores Blancas")
TOWNS = "Springfield Riverside Leeds Bristol Norwich Exeter Berlin Kassel Ulm Bonn Lyon Nantes Rennes Dijon Sevilla Murcia Toledo Oviedo Vienna Basel Austin Denver Portland Salem".split()
TOWN_FORMS = ("Upper {}", "Lower {}", "New {}", "Port {}", "{} Bay", "{} Heath", "{} Hill", "Bad {}", "{} am See", "Saint-{}", "{}-sur-Mer", "Villa {}", "San {}", "{} de la Sierra", "Great {}", "{}-le-Grand", "Lake {}")
STATES = "CA TX NY IL OH WA OR CO MA PA".split()
DOMAINS = ("example.com", "example.org", "example.net", "test.example", "company.test", "club.example", "a-b.example.org", "uni.example.edu", "mail.test", "host.invalid", "box7.example.com", "x.invalid")
FOLD = str.maketrans("äöüéèàáíóúñøßçêâîôûë'", "aoueeaaiounosceaioue-")


class Writer:
    def __init__(self, lexicon: Lexicon, seed: int):
        self.r = random.Random(seed)
        title = lambda s: "-".join(p[:1].upper() + p[1:] for p in s.split("-"))
        self.given = [title(x) for x in sorted(lexicon.given)]
        self.family = [title(x) for x in sorted(lexicon.family)]
        self.places = [" ".join(title(w) for w in p.split()) for p in sorted(lexicon.places)]
        self.common = [title(x) for x in sorted(GIVEN)]
        self.gold: set[tuple[int, int, str]] = set()
        self.cued = False

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def invented(self) -> str:
        r = self.r
        s = "".join(r.choice(("b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "th", "st", "kr", "w", "c")) + r.choice("aeiouaeiouyö") for _ in range(r.randint(1, 3)))
        return (s + r.choice(("n", "rt", "l", "", "sk", "m", "nson", "berg", "ton", "ini", "ez", "mann", "ier", "field", "worth", "ley", "ner", "sen"))).capitalize()

    def made(self) -> str:
        """A capitalised word for a thing: a compound, or an invented one."""
        r, x = self.r, self.r.random()
        if x < 0.4:
            return r.choice(DNOUNS) + r.choice(("", "s", "n")) + r.choice(DNOUNS).lower()
        if x < 0.7:
            return self.invented() + r.choice(("ung", "heit", "keit", "tion", "schaft", "ment", "ness", "ity", "ing", "er", "ics", "ism", "age", "ure", "net", "Soft", "-Server"))
        return r.choice(NOUNS).capitalize() + r.choice(NOUNS)

    def given_name(self) -> str:
        r, x = self.r, self.r.random()
        s = r.choice(self.given) if x < 0.5 and self.given else r.choice(self.common) if x < 0.8 else self.invented()
        return f"{s}-{r.choice(self.common)}" if r.random() < 0.02 else s

    def family_name(self) -> str:
        r, x = self.r, self.r.random()
        s = r.choice(self.family) if x < 0.5 and self.family else r.choice(FAMILY) if x < 0.7 else self.invented()
        y = r.random()
        return f"{s}-{r.choice(FAMILY)}" if y < 0.03 else f"{r.choice(('von', 'van', 'de', 'del', 'de la', 'van der', 'di'))} {s}" if y < 0.07 else s

    def name(self) -> str:
        r = self.r
        g, f = self.given_name(), self.family_name()
        gap = r.choices((" ", " ", "\n"), (92, 4, 4))[0]
        i, j = r.choice("ABCDEFGHIJKLMNOPRSTUVWZ"), r.choice("ABCDEFGHJKLMNPRSTW")
        build = r.choices(("gf", "f", "f,g", "if", "gif", "iif", "g", "up", "low"), (50, 8, 8, 8, 7, 2, 8, 5, 4))[0]
        if build in ("f", "g") and not self.cued and r.random() < 0.8:
            g, f = (r.choice(self.given) if self.given else g), (r.choice(self.family) if self.family else f)
        if build == "low":
            listed = (r.choice(self.given), r.choice(self.family)) if self.given and self.family else (g, f)
            return r.choice((" ".join(listed), listed[0], listed[1])).lower()
        return {"gf": f"{g}{gap}{f}", "f": f, "f,g": f"{f}, {g}", "if": f"{i}. {f}", "gif": f"{g} {i}. {f}", "iif": f"{i}. {j}. {f}", "g": g, "up": f"{g}{gap}{f}".upper()}[build]

    def email(self) -> str:
        r = self.r
        g, f = (x.lower().translate(FOLD).replace(" ", "") for x in (self.given_name(), self.family_name()))
        local = r.choice((f"{g}.{f}", f"{g[0]}{f}", f"{g}-{f}", f"{g}_{f}", f"{f}{self.d(2)}", f"{g}.{f}{self.d(1)}", f"{f}.{self.d(3)}", f"{g}+{r.choice(NOUNS)}", "info", r.choice(NOUNS), f"{r.choice(NOUNS)}.{r.choice(NOUNS)}", f"{f}.{g[0]}"))
        host = r.choice((r.choice(DOMAINS), f"{r.choice(NOUNS)}.{r.choice(('example', 'test', 'invalid', 'com', 'org', 'de', 'fr', 'es', 'co.uk', 'example.org'))}", f"{r.choice(ADJS)}-{r.choice(NOUNS)}.{r.choice(('example', 'test', 'net'))}"))
        how = r.random()
        o, c = r.choice(("()", "[]", "{}"))
        s = r.choice(("", " "))
        if how < 0.72:
            out = f"{local}@{host}"
        elif how < 0.77:
            out = f"{local} @ {host}"
        elif how < 0.83:
            out = f"{local}{s}{o}at{c}{s}{host}"
        elif how < 0.91:
            out = f"{local}{s}{o}at{c}{s}" + host.replace(".", f"{s}{o}dot{c}{s}")
        else:
            out = f"{local} at {host.replace('.', ' dot ')}"
        return out.upper() if r.random() < 0.08 else out

    def phone(self) -> str:
        d, r = self.d, self.r
        g = r.choice((" ", " ", "-", ".", " "))
        cc = r.choice(("1", "44", "49", "33", "34", "41", "43", "39", "351"))
        groups = lambda *ns: g.join(d(n) for n in ns)
        s = r.choice((
            lambda: groups(3, 3, 4), lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+1{g}{groups(3, 3, 4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{cc}{d(9)}", lambda: f"+1{d(10)}",
            lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"02{d(1)} {d(4)} {d(4)}", lambda: f"(0{d(3)}) {d(6)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}", lambda: f"07{d(3)} {d(6)}", lambda: f"07{d(9)}", lambda: f"0{d(4)} {d(3)} {d(3)}",
            lambda: f"+44 (0){d(2)} {d(4)} {d(4)}", lambda: f"+44 {groups(2, 4, 4)}", lambda: f"+44 {d(4)} {d(6)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(2)} {d(7)}", lambda: f"0{d(3)}-{d(6)}", lambda: f"0{d(2)} {d(4)}-{d(3)}", lambda: f"+49 {d(2)} {d(7)}",
            lambda: f"+49 (0){d(3)} {d(6)}", lambda: f"+49 {d(3)} {d(5)}-{d(2)}", lambda: f"0049 {d(3)} {d(7)}", lambda: f"00{cc} {groups(2, 3, 4)}", lambda: f"0{d(1)}{g}{groups(2, 2, 2, 2)}", lambda: f"0{d(9)}", lambda: f"+33 {d(1)} {groups(2, 2, 2, 2)}", lambda: f"+33 (0){d(1)} {groups(2, 2, 2, 2)}",
            lambda: f"9{d(2)}{g}{groups(3, 3)}", lambda: f"6{d(2)}{g}{groups(2, 2, 2)}", lambda: f"9{d(1)} {d(3)} {groups(2, 2)}", lambda: f"+34 {groups(3, 3, 3)}", lambda: f"+34 {d(3)} {groups(2, 2, 2)}", lambda: f"+{cc} {groups(2, 3, 2, 2)}", lambda: f"+{cc} {d(2)} {d(5)} {d(3)}", lambda: f"00{cc} (0){d(2)} {d(5)}-{d(3)}",
        ))()
        if r.random() < 0.14:
            s += r.choice((" ext. ", " ext ", ", ext. ", " extension ", " x", "x", " Durchwahl ", " poste ", " ext."))[0:] + d(r.randint(1, 4))
        return s

    def local_phone(self) -> str:
        d, g = self.d, self.r.choice(" -./")
        return self.r.choice((lambda: g.join((d(3), d(3), d(3))), lambda: f"{d(3)} {d(3)} {d(4)}", lambda: g.join((d(3), d(2), d(2), d(2))), lambda: f"{d(4)} {d(6)}", lambda: d(9), lambda: d(10), lambda: f"{d(5)}-{d(3)}-{d(1)}", lambda: f"{d(5)}-{d(3)}-{d(2)}"))()

    def table(self) -> str:
        """A row of numbers."""
        g = self.r.choice((" ", "  ", "-", "/", ", "))
        n = self.r.randint(2, 6)
        return g.join(self.d(self.r.randint(1, 5)) for _ in range(n)) if self.r.random() < 0.5 else g.join([self.d(n) for _ in range(self.r.randint(2, 5))])

    def designation(self) -> str:
        """What objects of catalogues, machines and products are called."""
        r, d = self.r, self.d
        w = "".join(r.choice("ABCDEFGHKLMNPRSTUVXZ") for _ in range(r.randint(2, 4)))
        return r.choice((f"{w} J{d(4)}.{d(1)}{r.choice('+-')}{d(4)}", f"{w} J{d(4)}{r.choice('+-')}{d(4)}", f"{d(1)}{w} J{d(4)}.{d(1)}{r.choice('+-')}{d(4)}", f"{w} {d(4)}", f"{w} {d(5)}", f"{w} {d(6)}", f"{w} B{d(4)}{r.choice('+-')}{d(2)}", f"{w} {d(3)}.{d(3)}", f"{w}-{d(4)}", f"{w}{d(5)}", f"J{d(6)}{r.choice('+-')}{d(4)}"))

    def no_mail(self) -> str:
        """Something written with @ that is no mail address."""
        r, d, w = self.r, self.d, self.r.choice(NOUNS)
        return r.choice((f"{w}@{d(1)}.{d(1)}.{d(2)}", f"{w}@{d(4)}.{d(1)}", f"{w}-{d(2)}@{d(3)}.{d(2)}", f"{w}@{r.getrandbits(24):06x}", f"{w}@{r.choice(NOUNS)}", f"user@10.0.{d(1)}.{d(2)}", f"{w}_{d(2)}@{d(2)}.{d(1)}", f"{r.choice(ADJS)}/{w}@v{d(1)}.{d(1)}", f"{w}@{d(2)}"))

    def id(self) -> str:
        d, r = self.d, self.r
        L = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPRSTWXYZQ") for _ in range(n))  # noqa: E731, N806
        sep = r.choice(("-", "/", " ", ".", "-"))
        return r.choice((
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{L(2)}{d(6)}{L()}", lambda: f"{L(2)} {d(2)} {d(2)} {d(2)} {L()}", lambda: f"{L(2)} {d(6)} {L()}", lambda: f"{L(2)}-{d(2)}-{d(2)}-{d(2)}-{L()}", lambda: d(9), lambda: d(8),
            lambda: f"{L()}{d(8)}", lambda: f"{L()}{d(7)}", lambda: L() + "".join(r.choice("CFGHJKLMNPRTVWXYZ0123456789") for _ in range(6)) + d(2), lambda: f"{L(2)}{d(7)}", lambda: f"{L(2)}-{d(7)}", lambda: f"{L(2)} {d(7)}", lambda: f"{d(2)}{L(2)}{d(5)}", lambda: f"{d(8)}{L()}", lambda: f"{d(8)}-{L()}", lambda: f"{d(2)}.{d(3)}.{d(3)}-{L()}", lambda: f"{L()}{d(7)}{L()}", lambda: f"{L()}-{d(7)}-{L()}",
            lambda: f"{d(2)} {d(6)} {L()} {d(3)}", lambda: f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{d(2)}/{d(8)}/{d(2)}", lambda: f"{L(r.randint(1, 3))}{sep}{d(r.randint(4, 6))}", lambda: f"{L(r.randint(2, 4))}{sep}{d(r.randint(2, 4))}{sep}{d(r.randint(3, 5))}", lambda: f"{L(3)}{sep}{d(3)}{sep}{d(4)}{sep}{L()}",
            lambda: f"{d(4)}{sep}{d(4)}", lambda: f"{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(2)}-{d(4)}-{d(2)}", lambda: d(r.randint(6, 7)), lambda: f"{L()}{d(5)}",
        ))()

    def town(self) -> str:
        r, x = self.r, self.r.random()
        if self.places and x < 0.4:
            return r.choice(self.places)
        one = r.choice(TOWNS) if x < 0.6 else self.invented()
        return r.choice(TOWN_FORMS).format(one) if r.random() < 0.35 else one

    def address(self) -> str:
        r, d = self.r, self.d
        n, kind, gap = str(r.randint(1, r.choice((60, 300, 9999)))), self.r.random(), self.r.choices((", ", ",\n", "\n"), (88, 8, 4))[0]
        if kind < 0.5:
            word = r.choice(EN_STREET) if r.random() < 0.5 else self.invented()
            word = f"{word} {r.choice(EN_STREET)}" if r.random() < 0.25 else f"St. {word}'s" if r.random() < 0.08 else f"{word}'s" if r.random() < 0.05 else word
            street = f"{n}{r.choice(('', '', '', 'a', 'B'))} {word} {r.choice(EN_KIND)}"
            unit = r.choices(("", f", Apt {r.randint(1, 99)}", f", Apt. {r.randint(1, 9)}B", f", Unit {r.randint(1, 40)}", f", Suite {r.randint(1, 400)}", f", Flat {r.randint(1, 20)}"), (70, 8, 4, 6, 6, 6))[0]
            uk = "".join(r.choice("BCEGLMNSW") for _ in range(r.randint(1, 2))) + d(1) + r.choice(("", d(1))) + " " + d(1) + "".join(r.choice("ABDEFGHJLN") for _ in range(2))
            tail = r.choice((f" {r.choice(STATES)} {d(5)}", f", {r.choice(STATES)} {d(5)}", f" {d(5)}", f", {d(5)}", f" {uk}", f", {uk}", "", "", ""))
            s = f"{street}{unit}{gap}{self.town()}{tail}"
            if r.random() < 0.12:
                s = f"{r.choice(('Flat', 'Apartment', 'Unit'))} {r.randint(1, 60)}, {s}"
            if r.random() < 0.04:
                s = street
        elif kind < 0.68:
            street = r.choice(DE_FREE) if r.random() < 0.2 else r.choice(DE_STREET) + r.choice(DE_KIND) if r.random() < 0.6 else self.invented() + r.choice(DE_KIND)
            s = f"{street} {n}{r.choice(('', '', '', 'a', ' b'))}{gap}{r.choice(('', '', '', 'D-'))}{d(5)} {self.town()}"
        elif kind < 0.84:
            rest = r.choice(FR_STREET) if r.random() < 0.6 else r.choice(("de la ", "du ", "des ", "")) + self.invented() + r.choice(("", "-" + self.invented()))
            s = f"{n}{r.choice(('', '', ' bis', ' ter'))}{r.choice((' ', ', '))}{r.choice(FR_KIND)} {rest}{gap}{d(5)} {self.town()}"
        elif kind < 0.97:
            rest = r.choice(ES_STREET) if r.random() < 0.6 else r.choice(("de la ", "del ", "de los ", "")) + self.invented() + r.choice(("", " " + self.invented()))
            s = f"{r.choice(ES_KIND)} {rest}{r.choice((' ', ' ', ', '))}{n}{r.choice(('', '', ', 3.º B', ', 1.º A', ', bajo', ', 2º'))}{gap}{d(5)} {self.town()}"
        else:
            s = f"{self.invented()} {self.invented()} {r.randint(1, 200)}, {d(r.choice((4, 5)))} {self.town()}"
        return s.upper() if r.random() < 0.06 else s

    def filler(self, slot: str) -> str:
        r = self.r
        if slot[0] == "d" and slot[1:].isdigit():
            return str(r.randint(1, 9)) + self.d(int(slot[1:]) - 1)
        if slot in TITLES:
            return r.choice(TITLES[slot])
        return {
            "role": lambda: r.choice(ROLES), "Role": lambda: r.choice(ROLES).capitalize(), "did": lambda: r.choice(DID), "drole": lambda: r.choice(D_ROLES), "ddid": lambda: r.choice(D_DID), "frole": lambda: r.choice(F_ROLES), "fdid": lambda: r.choice(F_DID), "erole": lambda: r.choice(E_ROLES), "edid": lambda: r.choice(E_DID),
            "count": lambda: r.choice(COUNTS), "Count": lambda: r.choice(COUNTS).capitalize(), "dcount": lambda: r.choice(D_COUNTS), "like": lambda: r.choice((self.id, self.id, self.local_phone, self.table))(), "maillike": self.no_mail,
            "Start": lambda: r.choice(START).capitalize(), "DStart": lambda: r.choice(D_START).capitalize(), "FStart": lambda: r.choice(F_START).capitalize(), "EStart": lambda: r.choice(E_START).capitalize(),
            "desig": self.designation, "Kind": lambda: r.choice(EN_KIND), "Made": self.made, "lab": lambda: r.choice(LABELS), "dlab": lambda: r.choice(D_LABELS), "flab": lambda: r.choice(F_LABELS), "elab": lambda: r.choice(E_LABELS),
            "fam": self.family_name, "fam2": self.family_name, "giv": lambda: r.choice((str, str.lower))(self.given_name()), "giv2": lambda: self.given_name().lower(), "place": self.town, "thing": lambda: r.choice(THINGS), "Thing": lambda: r.choice(THINGS).capitalize(),
            "noun": lambda: r.choice(NOUNS), "Noun": lambda: r.choice(NOUNS).capitalize(), "adj": lambda: r.choice(ADJS), "Adj": lambda: r.choice(ADJS).capitalize(), "DNoun": lambda: r.choice(DNOUNS), "fnoun": lambda: r.choice(FNOUNS), "enoun": lambda: r.choice(ENOUNS),
            "hex": lambda: f"{r.getrandbits(32):08x}", "L": lambda: r.choice("ABCDEFGH"), "date": lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.20{self.d(2)}",
        }[slot]()

    def fill(self, frame: str, at: int) -> str:
        """The frame with its slots filled; entities are noted from position ``at`` on."""
        out, kinds = "", {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}
        pos = 0
        while (i := frame.find("{", pos)) >= 0:
            out += frame[pos:i]
            j = frame.index("}", i)
            slot = frame[i + 1 : j]
            pos = j + 1
            # a title, a role or a greeting stands before
            self.cued = frame[:i].rstrip().endswith(("ttl}", "ole}", "Dear", "Hi", "Liebe", "Hallo", "Cher", "Chère", "Bonjour", "Estimada", "Hola,"))
            if slot in kinds:
                s = getattr(self, slot)()
                self.gold.add((at + len(out), at + len(out) + len(s), kinds[slot]))
                out += s
            else:
                out += self.filler(slot)
        return out + frame[pos:]

    def text(self) -> tuple[str, set[tuple[int, int, str]]]:
        r = self.r
        self.gold = set()
        frames = r.choices((EN, DE, FR, ES), (55, 15, 15, 15))[0]
        between = r.choice((" ", " ", " ", "\n", "\n- ", "\n* ", "\n\n", "; "))
        out = r.choice(("", "", "", "- ", "> ", f"{r.randint(1, 23)}:{r.randint(10, 59)} ", f"20{self.d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}: ", "Subject: plan\n\n", "Q: ", "# Notes\n\n"))
        for k in range(r.randint(1, 3)):
            out += between if k else ""
            if r.random() < 0.42:
                out += self.fill(r.choice(frames), len(out))
            else:
                plain = self.fill(r.choice(PLAIN), len(out))
                out += r.choices((str, str.title, str.upper, str.lower), (80, 8, 8, 4))[0](plain)
        return out, self.gold


def labelled_texts(lexicon: Lexicon, n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    w = Writer(lexicon, seed)
    return [w.text() for _ in range(n)]
