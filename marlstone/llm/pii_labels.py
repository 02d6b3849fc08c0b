"""The small labelled table the tagger of personal information is trained from.

Rows are sentence forms labelled by hand: a slot in braces is a mention of that kind (or, for kinds without a label, wording
that looks like one and is none). GENERAL has everyday and legal wording of three languages, written for this table; RULINGS
has forms as court rulings have them, labelled after such rulings. Each row is filled several times with invented names and
numbers in the usual spellings, and in a part of GENERAL's fillings other words take the place of the row's own.
"""

from __future__ import annotations

import random
import re

LABELS = {"P": "person_name", "A": "street_address", "E": "email", "T": "phone", "I": "id_number"}

#: {n}: bare initials, bare surnames and redaction marks; {s}: a bare surname; {c}: a company; {d}: a docket; {w}: a town;
#: {b}: plain wording; {u}: the same in capitals; {k}: a German clause; {f}: a French one; {h}: a page header; {g}: a court;
#: {m}: a number of another thing; {r}: a road or place without a number;
#: {o}: a capitalised name of anything else.
GENERAL = r"""
{P} signed the lease. {b}
{P} and {P} bought the cottage together.
My neighbour {P} moved away last spring. {b}
Yesterday {P} told the inspector that {b}
The defendant, {P}, denied everything. {b}
The plaintiff {P} seeks damages from {c}.
The tenant {n} seeks damages from {c}.
{P} (claimant) against {P} (defendant)
{P} (claimant) against {c} (defendant)
{c} (applicant) and {P} (opponent)
{n} (claimant) against {n} (defendant)
{n} (applicant) and {c} (opponent)
Parties: {P}, {c}, {P}
Parties: {n}, {c}, {n}
The case of {P} ({A}, {w}) versus {n}
The case of {n} of {n}, {w} versus {P}
{P}, living at {A}, {w}, complains of {c}.
{P}, judge
Judge {P} delivered the opinion of the court. {b}
Presided over by {P} and {P}
Panel: {P}, {P}, {n}
In the presence of {P}, clerk
In the presence of {n}, clerk
For the claimant: {P} of counsel. For the defendant: {P}
Mrs {P} appeared in person. {b}
Mr {n} appeared in person. {b}
Ms {s} appeared late. {b}
Dr {P} examined the patient. {b}
Dr {n} examined the patient. {b}
Professor {P} wrote the expert report. {b}
The expert {P} was heard by video link. {b}
The expert {n} was heard by video link. {b}
A witness named {P} remembered the car. {b}
A witness named {n} remembered the car. {b}
{b} as {P} explained, {b}
{b} as {s} explained, {b}
{b} said {P}, who knew {P} well.
{b} said {s}, who knew {n} well.
It was {P} who opened the safe, not {n}.
{P} testified first. {b} {P} did not testify.
{n} testified first. {b} {n} did not testify.
Asked by {P}, the driver {P} nodded.
Her brother {P} inherited the farm and sold it to {c}.
Their children {P}, {P} and {P} attended school in {w}.
Signed: {P}
Signed: {n}
Yours faithfully, {P} \n {b}
{P} \n Secretary \n {b}
From: {P} <{E}>
To: {P}; copy: {P}
I refer to the statement by {P} dated 3 May 2014. {b}
We spoke with {P} ({T}) about the accident. {b}
The estate of {P} was divided in {w}.
Attorney {P} withdrew, and {P} took over.
{P} v {n}: {b}
Kläger: {P}, {A}, {w}
Klägerin: {n}, {w}
Beklagte: {P}, {w}
Beklagte: {c}, {w}
{P} klagt gegen {c} auf Zahlung. {k}
{P} gegen {P} wegen Räumung
{n} gegen {n} wegen Räumung
{c} gegen {P} wegen Kaufpreis
Richterin {P} verkündete das Urteil. {k}
Es wirkten mit: {P}, {P} und {n}
Vorsitz: {P}
Vorsitz: {n}
Der Sachverständige {P} erläuterte seinen Bericht. {k}
Der Sachverständige {n} erläuterte seinen Bericht. {k}
Zeugin {P} erinnerte sich genau. {k}
Zeuge {s} erinnerte sich nicht. {k}
Herr {P} zog nach {w}. {k}
Herr {n} zog nach {w}. {k}
Frau {s} zog nach {w}. {k}
Frau Professor {P} lehrt in {w}. {k}
Rechtsanwalt {P} vertrat die Mieter, Rechtsanwältin {P} den Vermieter.
{k} sagte {P}. {k}
{k} sagte {n}. {k}
Wie {P} schrieb, {k}
Die Nachbarn {P} und {P} stritten um den Zaun.
Mit freundlichen Grüßen {P}
gezeichnet {P}
gezeichnet {n}
Der Vermieter {P} kündigte. {k}
Demandeur : {P}, {A}, {w}
Demanderesse : {n}, {w}
Défenderesse : {P}
Défenderesse : {c}, {w}
{P} contre {P}
{P} contre {c}
{c} contre {P}
{n} contre {n}
{P} réclame une somme à {c}. {f}
La juge {P} a rendu sa décision. {f}
Présents : {P}, {P} et {n}
Président : {P}
Président : {n}
L'expert {P} a déposé son rapport. {f}
L'expert {n} a déposé son rapport. {f}
Madame {P} habite {w}. {f}
Monsieur {P} habite {w}. {f}
Monsieur {n} habite {w}. {f}
Mme {s} habite {w}. {f}
Maître {P} représente la société {s}. {f}
Le témoin nommé {P} se souvient. {f}
Un voisin, {P}, appela la police. {f}
{f} dit {P}. {f}
{f} dit {n}. {f}
D'après {P}, {f}
D'après {n}, {f}
Signé : {P}
Cordialement, {P}
Le docteur {P} a soigné {P}. {f}
Write to {E} for details. {b}
Write to {n} for details. {b}
Her address was {E} at that time. {b}
{b} using the account {E}, {b}
E-mail: {E} \n {b}
Mail {E} or call {T}. {b}
{b} <{E}> {b}
Please reply to {E}.
She wrote from {E} on Monday. {b}
Kontakt: {E}, {T}
Schreiben Sie an {E}. {k}
{k} per Mail an {E}. {k}
Die Nachricht kam von {E} am Montag. {k}
Écrivez à {E}. {f}
Adresse électronique : {E} \n {f}
Le message venait de {E}. {f}
Mél. {E} ou {T}
{E} \n {T}
{E}, {T}
Phone: {T} \n {b}
Phone: {n} \n {b}
Ring {T} after six. {b}
She dialled {T} twice. {b}
His mobile, {T}, was switched off. {b}
Fax {T}. {b}
{b} on {T}. {b}
{b} ({T}) {b}
Two calls from {T} were recorded that night. {b}
Call us: {T}
Telefon {T} \n {k}
Telefon: {n} \n {k}
Handy: {T}. {k}
Er rief {T} an. {k}
Anrufe von {T} sind belegt. {k}
Sie erreichen uns unter der Nummer {T}. {k}
Téléphone : {T} \n {f}
Téléphone : {n} \n {f}
Appelez le {T}. {f}
Son portable, {T}, était éteint. {f}
Deux appels du {T} furent relevés. {f}
Passport {I} expired in March. {b}
Passport {n} expired in March. {b}
His social security number is {I}. {b}
Tax number: {I} \n {b}
National insurance number {I}; {b}
ID card {I} was lost. {b}
ID: {I}
The holder of card {I} could not be traced. {b}
The number {I} was on her papers. {b}
Driving licence {I} was issued in {w}.
Ausweis {I} wurde verloren. {k}
Ausweisnummer: {I} \n {k}
Die Steuernummer lautet {I}. {k}
Reisepass Nr. {I}, {w}
Sozialversicherungsnummer {I}. {k}
Die Nummer {I} stand auf dem Pass. {k}
Le passeport {I} a expiré. {f}
Numéro fiscal : {I} \n {f}
Sa carte d'identité, {I}, a été perdue. {f}
Sécurité sociale {I}. {f}
Le document porte {I}. {f}
{P} (ID {I}) left {w}.
{P}, born in {w}, passport {I}
They live at {A}. {b}
They live at {A}, {w}. {b}
The house at {A} burned down. {b}
A parcel was left at {A}, {w}, for {P}.
Address: {A} \n {w} \n {b}
Address: {n} \n {w} \n {b}
{b} outside {A}. {b}
{b} outside {r}. {b}
Flat 2, {A}, {w}
{A}, {w}
{A} \n {w} \n {b}
The shop in {r} closed. {b}
They met in {r} by chance. {b}
Police searched {A} and {A}. {b}
{A} belonged to {c}. {b}
Er wohnt {A} in {w}. {k}
Adresse: {A}, {w} \n {k}
Das Haus {A} brannte ab. {k}
Die Wohnung {A}, {w}, stand leer. {k}
{k} in der {A}. {k}
Der Laden in der {r} schloss. {k}
Zustelladresse: {A}, {w}
Elle habite {A} à {w}. {f}
Adresse : {A}, {w} \n {f}
La maison du {A} a brûlé. {f}
Le colis est resté au {A}. {f}
Le magasin de la {r} ferma. {f}
domicilié {A}, {w}, {f}
{h} \n {b}
{b} \n {h} \n {b}
{k} \n {h} \n {k}
{f} \n {h} \n {f}
{g} \n {d} \n {b}
{g}, {d}
{g} \n {d} \n {P} \n {b}
{d} \n {b}
Case {d}. {b}
Az. {d}. {k}
Affaire {d}. {f}
{b} cited {s} v {s}, {d}. {b}
{b} as in {s} v {c} ({d}). {b}
{b} ({s} v {s}) {b}
{k} so {s} gegen {s}, {d}. {k}
{k} siehe {s} ./. {s}, {d}. {k}
{f} dans {s} c. {s}, {d}. {f}
{f} voir {s} contre {c}, {d}. {f}
{m} {b}
{b} {m} {b}
{b} {m} {b} {m} {b}
{k} {m} {k}
{f} {m} {f}
{b} {m}
{c} paid. {b}
{b} {c} refused. {b}
{k} {c} zahlte. {k}
{f} {c} refusa. {f}
{r} was repaired. {b}
{r} wurde gesperrt. {k}
{r} fut fermée. {f}
{b} {b} {b}
{k} {k} {k}
{f} {f} {f}
{u}
{b} {u} {b}
{k} {u} {k}
{o} closed in winter. {b}
{b} {o} {b}
{b} {o} {b} {o} {b}
The {o} was amended. {b}
the {o} and the {o}
{k} {o} {k}
Das {o} galt fort. {k}
{f} {o} {f}
Le {o} fut modifié. {f}
{o}
{o} \n {b}
{n} {b}
{b} {n} and {n} {b}
{k} {n} und {n} {k}
{f} {n} et {n} {f}
1. {b} \n 2. {b}
(4) {b} \n \n (5) {b}
[6] {k} \n [7] {k}
8 {f} \n \n 9 {f}
{w}, 4 June 2011 \n {b}
{w}, den 4. Juni 2011 \n {k}
{w}, le 4 juin 2011 \n {f}
Judgment of 7 March 1999 \n {b}
{P}, {P}
{P}; {n}; {P}
between {P} and {n}
zwischen {P} und {c}
entre {P} et {n}
for {P}: {P}
by {P}, {b}
von {P}, {k}
par {P}, {f}
with {P} in {w} {b}
mit {P} in {w} {k}
avec {P} à {w} {f}
to {P} \n {b}
an {P} \n {k}
à {P} \n {f}
"""

RULINGS = r"""
Between: {P} (Appellant) and {P} (Respondent)
Between: {P} (Appellant) and {c} (Respondent)
Between: {c} (Appellant) and {P} (Respondent)
Between: {P} of {A}, {w} (Appellant) and {n} (Respondent)
Between: {n} (Appellant) and {P} of {A}, {w} (Respondent)
Between: {n}, {w} (Appellant) and {n} (Respondent)
Between: {n} of {n}, {w} (Appellant) and {c} (Respondent)
Between: {c} (Appellant) and {c} (Respondent)
{g} \n {d} \n Between: {P} (Appellant) and {c} (Respondent)
{g} \n Before {P}, presiding \n 1. {b}
Before {P}, presiding
Before {n}, presiding
So said {P}. {b}
So said {n}. {b}
{b} So said {P}.
{P} was cross-examined. {b}
{n} was cross-examined. {b}
The evidence of {P} was that {b}
The evidence of {n} was that {b}
Dr {P}, called as an expert, was not challenged.
Dr {n}, called as an expert, was not challenged.
According to {P}, who gave evidence, {b}
According to {n}, who gave evidence, {b}
Mr {n} put it, {b}
Ms {s} put it, {b}
Mr {P} put it, {b}
{b} Counsel {P} agreed with {P} and {n}.
The witness {P} and her son {P} left for {w}.
In der Sache {P}, Klägerseite, gegen {P}, Beklagtenseite
In der Sache {P}, {A}, {w}, Klägerseite, gegen {c}, Beklagtenseite
In der Sache {c}, Klägerseite, gegen {P}, {A}, {w}, Beklagtenseite
In der Sache {n}, Klägerseite, gegen {n}, Beklagtenseite
In der Sache {n}, {n}, {w}, Klägerseite, gegen {P}, Beklagtenseite
unter Vorsitz von {P}
unter Vorsitz von {n}
unter Vorsitz von {P} \n Leitsatz: {k}
Die Zeugin {P} hat ausgesagt. {k}
Die Zeugin {n} hat ausgesagt. {k}
Frau Dr. {P} erstattete das Gutachten. {k}
Frau Dr. {n} erstattete das Gutachten. {k}
Nach Angaben von {P} gilt: {k}
Nach Angaben von {n} gilt: {k}
So der Zeuge {P}. {k}
So der Zeuge {n}. {k}
Herr {n} blieb dabei. {k}
Herr {s} blieb dabei. {k}
En cause de {P}, demandeur, contre {P}, défendeur
En cause de {P}, {A}, {w}, demandeur, contre {c}, défendeur
En cause de {c}, demandeur, contre {P}, {A}, {w}, défendeur
En cause de {n}, {n}, {w}, demandeur, contre {n}, défendeur
Sous la présidence de {P}
Sous la présidence de {n}
Sous la présidence de {P} \n Sommaire : {f}
Le témoin {P} a été entendu. {f}
Le témoin {n} a été entendu. {f}
Me {P}, avocat, a plaidé. {f}
Me {n}, avocat, a plaidé. {f}
M. {n} n'a pas comparu. {f}
M. {s} n'a pas comparu. {f}
M. {P} n'a pas comparu. {f}
C'est ce qu'a déclaré Mme {P}. {f}
C'est ce qu'a déclaré Mme {n}. {f}
Selon {P}, {f}
Selon {n}, {f}
Service by electronic mail at {E} was admitted. {b}
Service by electronic mail at {n} was admitted. {b}
Papers were sent to {E}. {b}
Papers were sent to {n}. {b}
Contact for the file: {E}; {b}
Contact for the file: {E} \n {h}
{b} ({E}) {b}
({E})
{E}. Tel. {T}
Die Zustellung erfolgte an {E}. {k}
Erreichbar unter {E}. Unter {T} meldete sich niemand.
E-Mail: {E} \n Tel.: {T}
Courriel : {E}
Courriel : {E}. Au {T} personne n'a répondu.
Copie fut adressée à {E}. {f}
Calls were placed to {T} on two evenings. {b}
Calls were placed to {n} on two evenings. {b}
The line {T} was answered by nobody. {b}
Tel. {T} \n {b}
Tel. {n} \n {b}
{b} telephone: {T} (office hours) {b}
{b} {T} (office hours) {b}
{b} {T} \n At the material time the family lived at {A}, {w}.
Tel.: {T} \n {k}
Rückfragen: {T} (vormittags) {k}
Unter {T} meldete sich niemand. {k}
Au {T} personne n'a répondu. {f}
Joignable au {T} le matin. {f}
Tél. {T} \n {f}
Tél. {n} \n {f}
Identity no. {I} was noted on the card. {b}
Identity no. {n} was noted on the card. {b}
{I} was noted on the card. {b}
The card shows {I} and no photograph. {b}
The card shows {n} and no photograph. {b}
The passport tendered bore the number {I}. {b}
The passport tendered bore the number {n}. {b}
{w} The passport tendered bore the number {I}. Tel. {T}
Personenkennzeichen: {I} \n {k}
Steuerliche Kennung {I}. {k}
Steuer1iche Kennung {I}. {k}
Der vorgelegte Ausweis trug die Nummer {I}. {k}
Numéro de sécurité sociale : {I} \n {f}
La carte produite porte le numéro {I}. {f}
Passeport n° {I}. {f}
Passeport n° {n}. {f}
Passeport n° {I}. {E}
Numéro de sécurité sociale : {I}
Personenkennzeichen: {I}
Steuerliche Kennung {I}. Tel.: {T}
Identity no. {I} was noted on the card. {A} in {w} was searched twice.
({E}) Tel. {T}
({E}) {T} (office hours)
{E}
Courriel : {E} Au {T} personne n'a répondu.
Contact for the file: {E}; Tel. {n}
Die Zustellung erfolgte an {E}.
Copie fut adressée à {E}.
Papers were sent to {E}. telephone: {n}
Tél. {T}
Tel.: {T} Wohnhaft {A}, {w}.
Rückfragen: {T} (vormittags) Anschrift: {A}, {w}
The notice was pinned to the door of {A}, {w}. {b}
The notice was pinned to the door of {n}, {w}. {b}
At the material time the family lived at {A}, {w}. {b}
{b} last known address: {A}, {w}
{A} in {w} was searched twice. {b}
{b} {A} in {w} was searched twice.
last known address: {A}, {w} Identity no. {I} was noted on the card.
last known address: Flat 3, {A}, {w}
Wohnhaft {A}, {w}. {k}
Anschrift: {A}, {w} \n {k}
Das Schreiben lag im Briefkasten {A}, {w}. {k}
Wohnhaft {n}, {w}. {k}
Demeurant {A}, {w}. {f}
Demeurant {n}, {w}. {f}
Adresse déclarée : {A}, {w} \n {f}
Le pli fut laissé au {A}, {w}. {f}
Adresse déclarée : {A}, {w} Passeport n° {I}. Tél. {T}
{h} \n {b}
{b} \n {h}
{g} \n {d} \n {b}
{d} \n \n {b}
Aktenzeichen {d} \n {k}
Rôle {d} \n {f}
{b} See {s} v {s} [2009] {d}. {b}
{b} (vgl. {s} ./. {s}, {d}) {k}
{b} Compare {s}-{s} v von {s}, {d}. {b}
{k} Voir {s} ./. de {s} [1998] {d}. {f}
{b} Cf. KGR 48, 364. See {d}. {b}
{b} So in {s} v {c}, {d}, and {s} v van der {s} [2011] KC 12. {b}
See paragraph 11 of the claim, docket 23180/11. {b}
Aktenzeichen 99269/86, Blatt 342. {k}
Dossier 82869/54, pièce 962. {f}
The bond XZ003995868440 was quoted at 40.40. {b}
Die Anleihe XZ006595481534 notierte bei 34,34. {k}
Le titre XZ005882680573 cotait 73,73. {f}
The holding rose from 16 to 645 in 2002. {b}
The fund wrote at 14.30 on 12.11.2016. {b}
The vessel bore the registration 40763 and drew 14 metres. {b}
Company no. 056136 4021 was struck off. {b}
Company no. 201843 7715 was struck off. {b}
Invoice no. 27429-66 for EUR 949 000 was never paid. {b}
Rechnung Nr. 64094-31 über 384 000 Euro blieb offen. {k}
Facture n° 30494-24 de 353 000 euros impayée. {f}
Lantern Hill was closed to traffic that winter. {b}
Der Torfweg war gesperrt. {k}
Le quai des Cordiers était fermé. {f}
Rue des Halles fut barrée. Copper Street stayed shut.
(1) {b} \n \n (2) {b}
(1) At first instance, {b}
{b} At first instance, {b} In fairness, {b}
{u}
{b} {u} {b}
In der Sache Société {s}, Klägerseite, gegen {P}, Beklagtenseite
In der Sache {P}, Klägerseite, gegen Société {s}, Beklagtenseite
En cause de Société {s}, demandeur, contre {P}, défendeur
En cause de {P}, demandeur, contre Société {s}, défendeur
Between: Société {s} (Appellant) and {P} (Respondent)
The fund wrote at 14.30 on 12.11.2016.
{b} The fund wrote at 09.15 on 03.10.1998. {b}
Der Fonds schrieb um 14.30 am 12.11.2016. {k}
Le fonds écrivit à 14.30 le 12.11.2016. {f}
1. {b} \n 2. {b}
§ 4 {b} \n \n § 5 {b}
[3] {k} \n \n [4] {k}
Rn. 7 {k}
7 {f} \n \n 8 {f}
Headnote. {b} {b}
Leitsatz: {k} {k}
Sommaire : {f} {f}
The letter named {P}, {P} and {n}; {b}
{b} Neither {P} nor {c} replied. {b}
"""

SURNAME_HEADS = "Ald Bex Cor Dun Esk Fal Gor Hax Ing Jor Kest Lom Mar Nev Orm Pel Quin Ros Sten Tor Ulm Vel Wen Yor Zan Brack Thorn Elk Drav Hask Ash Bar Bell Cald Crow Dagg Ess Fair Gran Harl Holl Kirk Lang Mall Nor Oak Pem Rad Sedd Tal Und Var Whit Brun Chev Gess Jans Krau Leff Moul Pasc Rich Schul Vogl Zimm".split()
SURNAME_TAILS = "by combe den ell fold gate hurst ick land mere ness over pole quist rath sted tov ulac vane worth zano esco nitz aki mann dale thorpe ton ley ford wick by bourne stead croft ham sworth mann bach stein feld berg hoff er ier eau ard in ot elle sen ski escu oni aro kov idis anen".split()
GIVEN_NAMES = "Anna Paul Marie Jonas Clara Hugo Emma Felix Louise Oskar Julia Simon Agnes Victor Nora Martin Ellen Robert Judith Peter Alice Georg Camille Thomas Sophie Henri Martha Lucas Irene David".split()
GIVEN_HEADS = "Al Bren Cas Dor Ed Flo Gar Hel Is Jo Ka Lio Mor Nes Ot Pir Ros Si Tan Ur Ver Wen Yo Zel Am Cor Al Ber Cor Dan El Fab Gis Hen Ir Jul Kat Lud Mar Nad Ol Pet Quen Rom Sab Thel Urs Val Wal Yv".split()
GIVEN_TAILS = "bel vin mer rod da kin rin tor la via na mund cred sel wyn ia abel mil ette ane an a bert ine ric ia us ette ina old mund le is ard tje on wen ora ya go".split()
STREETS = {
    "en": ("Maple|Church|Victoria|Bridge|Orchard|Windmill|Abbey|Long Acre|East Park|St Mary's|Cherry Tree|Foundry|Albert|Queen's|Castle|Meadow|Harbour View|Old School".split("|"), "Street Road Lane Avenue Drive Close Gardens Square Terrace Place Court Way Row Walk Hill Mews Crescent Grove Wharf St Rd Ave Ln Ct".split()),
    "de": ("Linden|Garten|Schul|Wald|Markt|Rosen|Wiesen|Schiller|Brunnen|Ring|Blumen|Tannen|Burg|Nelken".split("|"), "straße weg gasse platz allee ring str. damm ufer".split()),
    "de_more": "Am Stadtpark|Alte Poststraße|Lange Gasse|Im Winkel|Zum Bahnhof|An den Weiden|Neuer Markt|Hinter der Kirche|Unter den Eichen|Obere Mühle|Karl-Anton-Straße|Georg-Weber-Weg|Am Rand".split("|"),
    "fr": ("rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|venelle|passage|route|square".split("|"), "de la Gare|des Lilas|du Marché|Victor-Noir|de l'Église|Neuve|des Trois-Ponts|du Vieux-Port|Pasteur|de la République|Saint-Michel|des Vignes|du Lavoir|de Bretagne|Basse|aux Herbes".split("|")),
}
TOWNS = "Great Askel|Thornwick Bay|Lower Pelham Cross|Carrowby|Dunmere|Wiesenrode|Neu-Ostrau|Bad Kelmen|Hallenbruck|Port-Cassel|Montreval-sur-Orne|Les Aubrettes|Saint-Orlan|East Marling|Kettle Ford|Oakford|Milbury|East Harwell|Stonebridge|Kirkby Sands|Port Ellery|Lindenau|Bad Waldsee|Neuhausen|Oberfeld|Altstadt-Süd|Saint-Aubin|Beaumont-le-Roi|Villeneuve|Les Essarts|Clairfont|Riverton|Unterbach|Roquebrune|Great Norley".split("|")
COURTS = "Court of Appeal at Carrowby|High Bench of Dunmere|Land and Tide Tribunal|Registrar's Court of Thornwick|Obergericht Hallenbruck|Kantongericht Wiesenrode|Cour de Justice de Port-Cassel|Tribunal d'Arbitrage de Montreval|Crown Court at Oakford|Supreme Court of Milbury|County Tribunal|Family Division|Landgericht Lindenau|Amtsgericht Oberfeld|Oberlandesgericht Neuhausen|Cour d'appel de Villeneuve|Tribunal de commerce de Clairfont|Cour suprême".split("|")
THINGS_NAMED = (
    "Fund Act Bridge Hotel Castle Award Treaty Ferry Line Register Chamber Journal Registry Deed Bond Charter Office Station Bay Harbour Island Council Ministry Report Court Bank Market Festival School Museum Union Agency Sea "
    "Fonds Gesetz Brücke Hafen Amt Verordnung Anzeiger Kammer Verband Zeitung Messe Bahn Kreis Loi Pont Banque Traité Gazette Bureau Musée Gare Chambre Conseil Mer Bourse Code Annexe"
).split()
PLAIN = (
    "the a any every such that this each bond trustee register was is had could not displace the late charge after before the holding lease permit notice of default once more and which during by reason strike holders bill lading in court below counsel for fund replied otherwise it an inference whether ship sailed quorum rule "
    "the a an this that these no any some his her their its our every each which who was were is are had has have did does will would may might must could should not never also only still again then there here "
    "claim appeal order judge court party parties evidence witness contract payment interest damage sum loan bank share seller buyer ship cargo house land rent owner tenant licence tax duty right duty breach loss price goods letter notice date year month day hearing judgment reason "
    "question answer argument point case fact law rule act section clause term condition agreement sale charge debt fund trust company board member vote report account record file copy paper document signature "
    "made paid sent given taken found held heard read said told asked agreed refused accepted dismissed allowed granted signed delivered received filed served proved shown known lost sold bought "
    "in on at by for from to of with without under over before after during until since because although while when where if unless than as and or but so more less most first second last later early clearly wholly partly"
).split()
OPENERS = "The In On If Each What Every Any It For That To With Until Such By Without Where Pending An At Under After The This That It There If When Where While After Before Because Although Since However Nothing Whether In On At By For Under No Any Each Such What He She They We Both".split()
GERMAN = "Beschluss Bürgschaft Gläubiger Nachfrist Vergleich Gutachten Frachtbrief Zinslauf Verwalter Klägerin Genossenschaft Emittentin Urkunde Rüge Verzicht Liegegeld Teilverzicht Zahlungsplan Treuhänderin Wegerecht Pächter Klausel Register Anhang Stichtag Molkerei Übergabe Vertrag Klage Gericht Urteil Zeuge Beweis Zahlung Zinsen Bank Verkäufer Käufer Schiff Ladung Haus Grundstück Miete Eigentümer Mieter Steuer Pflicht Recht Verlust Preis Ware Brief Frist Jahr Monat Tag Grund Frage Antwort Gesetz Regel Abschnitt Vereinbarung Verkauf Schuld Gesellschaft Vorstand Mitglied Bericht Konto Akte Kopie Unterschrift Berufung Antrag Kosten Schaden Summe Darlehen Anteil Sicherheit Forderung Verfahren Entscheidung Erklärung Nachweis Gegenstand Umstand".split()
GERMAN_SMALL = "die der das nach ohne hat im unter vor zur steht fest bleibt nicht berührt soweit dass ob je Quartal über wie ein streitige notarielle verspätete aus dem zweiten der die das den dem des ein eine einer einen und oder aber denn weil dass wenn als ob nicht kein keine nur auch noch schon dann hier dort mit ohne gegen für von zu zum zur bei nach vor über unter zwischen während seit bis wurde war ist sind hat haben hatte wird kann muss soll darf blieb bleibt liegt steht gilt folgt ergibt erging geprüft bezahlt gesandt erteilt gehört gelesen gesagt gefragt vereinbart abgelehnt angenommen unterschrieben geliefert verkauft gekauft verloren".split()
GERMAN_OPENERS = "Die Der Das Ob Dass Soweit Im Zu Hilfsweise Jedenfalls Darüber Demgegenüber Der Die Das Ein Eine Es Er Sie Wenn Weil Dass Ob Nach Vor Mit Ohne Gegen Bei Im Am Zum Nur Auch Damit Dagegen Daher Hier Dort Erst Zwar".split()
FRENCH = (
    "la le les de du des créance subordonnée après clôture l' offre acte fiducie séquestre registre titres délai de grâce échéancier garant oppose prime de retard sans accord porteurs ne remplace pas pendant instance droit vote sous réserve "
    "le la les un une des du de l' d' ce cette ces son sa ses leur leurs aucun aucune tout toute qui que dont où est sont était a ont avait sera peut doit ne pas plus jamais aussi encore déjà alors ici "
    "contrat demande appel juge tribunal partie preuve témoin paiement intérêt dommage somme prêt banque part vendeur acheteur navire cargaison maison terrain loyer propriétaire locataire impôt devoir droit perte prix lettre avis date année mois jour audience arrêt motif question réponse argument fait loi règle article clause terme condition accord vente dette fonds société conseil membre rapport compte dossier copie pièce signature "
    "fait payé envoyé donné pris trouvé tenu entendu lu dit demandé convenu refusé accepté rejeté accordé signé livré reçu déposé prouvé montré connu perdu vendu acheté "
    "dans sur à par pour avec sans sous entre avant après pendant depuis jusque parce si mais et ou donc car comme quand"
).split()
FRENCH_OPENERS = "Le La Si Dès Rien Pour C'est L'intimé Après Malgré Toutefois Le La Les Un Une Il Elle Ce Cette Si Quand Après Avant Pour Dans Sur Par Avec Sans Mais Or Ainsi Aucun Rien Tout Enfin Cependant L'accord D'abord".split()


#: Words whose identity the tagger may use: those of the lists above and of the rows themselves, but no names.
LEXICON = frozenset(
    w.lower()
    for text in (*THINGS_NAMED, *PLAIN, *OPENERS, *GERMAN, *GERMAN_SMALL, *GERMAN_OPENERS, *FRENCH, *FRENCH_OPENERS, *COURTS, *STREETS["en"][1], *STREETS["de"][1], *STREETS["fr"][0], re.sub(r"\{\w\}|\\n", " ", GENERAL + RULINGS))
    for w in re.findall(r"[^\W\d_]+", text)
) | frozenset("plc ltd co ag gmbh sa kg llp inc nv sarl fils sons daughters bank société banque holding insurance versicherung shipping partners trust cooperative und et v c contre gegen".split())


class Filler:
    """Seeded fillings of the slots; ``given`` are given names to draw from beside invented ones."""

    def __init__(self, given: list[str], seed: int) -> None:
        self.rng, self.given, self.rulings = random.Random(seed), given, False

    def pick(self, options):
        return self.rng.choice(options)

    def digits(self, n: int) -> str:
        return "".join(str(self.rng.randrange(10)) for _ in range(n))

    def number(self, form: str) -> str:
        """``form`` with every 0 a digit and every @ a capital letter."""
        return re.sub("[0@]", lambda m: self.digits(1) if m.group() == "0" else self.pick("ABCDEFGHJKLMNPRSTWXYZ"), form)

    def made(self) -> str:
        return self.pick(SURNAME_HEADS) + self.pick(SURNAME_TAILS)

    def unknown(self) -> str:
        return self.made().lower() if self.rng.random() < 0.6 else self.pick([PLAIN, GERMAN_SMALL, FRENCH][self.rng.randrange(3)])

    def surname(self) -> str:
        name, kind = self.made(), self.rng.random()
        if kind < 0.08:
            return f"{name}-{self.made()}"
        if kind < 0.2:
            return self.pick(["van ", "van den ", "von ", "zu ", "de ", "du ", "della ", "O'", "Mac", "D'"]) + name
        return name

    def first(self) -> str:
        kind = self.rng.random()
        if self.given and kind < 0.4:
            return self.pick(self.given)
        return self.pick(GIVEN_NAMES) if kind < 0.55 else self.pick(GIVEN_HEADS) + self.pick(GIVEN_TAILS)

    def letter(self) -> str:
        return self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "."

    def P(self) -> str:
        first, last, kind = self.first(), self.surname(), self.rng.random()
        if kind < 0.14:
            first = self.letter() + (self.letter() if self.rng.random() < 0.4 else "")
        elif kind < 0.28:
            first += " " + self.letter()
        elif kind < 0.33:
            first += self.pick([" ", "-"]) + self.first()
        style = self.rng.random()
        if style < 0.2:
            return f"{first} {last}".upper()
        if style < 0.3:
            return f"{first} {last.upper()}"
        if style < 0.38:
            return f"{last.upper()}, {first}"
        if style < 0.44:
            return f"{last}, {first}"
        if style < 0.48 and self.rulings:
            return f"{first} {last}".lower()
        return f"{first} {last}"

    def street(self) -> tuple[str, str]:
        kind = self.rng.random()
        if kind < 0.45:
            return "en", f"{self.pick([*STREETS['en'][0], self.made()])} {self.pick(STREETS['en'][1])}"
        if kind < 0.6:
            return "de", self.pick([*STREETS["de"][0], self.made()]) + self.pick(STREETS["de"][1])
        if kind < 0.75:
            name = self.pick([*STREETS["de_more"], f"{self.made()}er {self.pick(['Straße', 'Weg', 'Platz', 'Gasse', 'Allee', 'Str.'])}", f"{self.made()}-{self.made()}-{self.pick(['Straße', 'Weg', 'Platz', 'Allee'])}"])
            return "de", name
        return "fr", f"{self.pick(STREETS['fr'][0])} {self.pick([*STREETS['fr'][1], 'de ' + self.made(), 'des ' + self.made() + 's', 'Saint-' + self.made()])}"

    def A(self) -> str:
        (language, street), n = self.street(), str(self.rng.randrange(1, 250))
        street = self.pick([street, street, street, street.upper()])
        if language == "de":
            return f"{street} {n}" + self.pick(["", "", "a", " b", " c", f"-{int(n) + 2}"])
        if language == "fr":
            return n + self.pick(["", "", " bis", " ter"]) + self.pick([" ", ", "]) + street
        return n + self.pick(["", "", "", "A", "B", "C"]) + self.pick([" ", " ", ", "]) + street

    def r(self) -> str:
        return self.street()[1]

    def E(self) -> str:
        first, last = self.first().lower(), re.sub(r"\W", "", self.surname().lower())
        user = self.pick([f"{first}.{last}", f"{first}_{last}", f"{last}.{first[0]}", f"{first[0]}{last}", f"{last}+{first}", f"{last}{self.digits(2)}", f"{first}-{last}", f"{first}{last}"])
        host = self.pick(["", "", "mail.", "post."]) + self.pick([self.made().lower(), f"{self.made().lower()}-{self.made().lower()}", "example"]) + self.pick([".example", ".test", ".invalid", ".org", ".com", ".eu", ".de", ".fr", ".net"])
        style = self.rng.random()
        if style < 0.12:
            return f"{user} (at) {host}"
        if style < 0.28:
            return f"{user} [at] " + host.replace(".", " [dot] ")
        if style < 0.4:
            return f"{user} @ {host}"
        if style < 0.46:
            return f"{user}@ \n{host}"
        return f"{user}@{host}".upper() if style < 0.56 else f"{user}@{host}"

    #: National and international forms of phone numbers in common use.
    PHONES = (
        "+44 00 0000 0000|000 0000 0000|0044 00 00000000|+44 (0)00 0000 0000|(000) 0000-0000|+1 000 000 0000|(00) 000 0000|000-0000|000.000.0000|(000) 000-0000|+1-000-000-0000|0049 00 00000000|000 00000 000|+49 (0)00 / 00000 000|"
        "(000) 00 000 - 000|+49 00 00000-000|0000/000000|01 00 00 00 00|01.00.00.00.00|+33 (0)1 00 00 00 00|+33 6 00 00 00 00|0033 100 00 0000|+41 00 000 00 00|0000 000000"
    ).split("|")
    #: Forms of passport, card, tax and social-security numbers in common use.
    PAPERS = (
        "@0000000|@@000000@|@@ 00 00 00 @|000-00-0000|000 00 0000|000000@000|00 000 000 000|@00@00000@|@00@00@000|00@@00000|1 00 00 00 000 000 00|2000000000000|00000000000|@@0000000|000000000|0000 0000 0000|00000000@|@@000000"
    ).split("|")
    #: Numbers of things that are no person's.
    THINGS = (
        "Invoice 0000-00 was open.|Invoice no. 00000/00 for EUR 000 000 was open.|Rechnung Nr. 0000-00 blieb unbezahlt.|Rechnung 00000-00 über 00 000 Euro|Facture n° 00000-00 impayée.|Company no. 000000 was wound up.|Company no. 000000 0000|"
        "Handelsregister HRB 00000|R.C.S. 000 000 000|Bond @@000000000000 fell.|ISIN @@0000000000|Die Anleihe @@000000000000 fiel.|Le titre @@000000000000 monta.|Vessel reg. 00000 sank.|The tug registered as 00000 drew 0 metres.|"
        "in 1900|on 12.11.2000|am 03.10.2000|le 12 mai 2000|at 00.00|um 00.00 Uhr|EUR 000 000|000 000 Euro|USD 00.00|00.00|00,00|00 per cent|page 00|Blatt 000|pièce 000|section 00(0)|§ 00 Abs. 0|article 000-0|paragraph 00|000 to 000|"
        "docket 00000/00|Aktenzeichen 00000/00|dossier 00000/00|lot 000|No. 00|Nr. 00|n° 00|[2000] @@ 00|@@@ 00, 000|vol. 0, p. 000"
    ).split("|")

    def T(self) -> str:
        return self.number(self.pick(self.PHONES))

    def I(self) -> str:  # noqa: E743
        return self.number(self.pick(self.PAPERS))

    def m(self) -> str:
        return re.sub(r"(?<=[12])\d{3}|0", lambda m: self.digits(len(m.group())), re.sub("@", lambda m: self.letter()[0], self.pick(self.THINGS)))

    def n(self) -> str:
        a, b = self.letter(), self.letter()
        return self.pick(["█████", "████", "XXXX", "XXX", "[redacted]", "[…]", "[...]", "***", "(name withheld)", "[anonymisiert]", a, a, a + b, a + b, f"{a} {b}", f"{self.first()} {a}", self.surname()])

    def s(self) -> str:
        return self.surname()

    def c(self) -> str:
        n = self.made()
        return self.pick([f"{n} plc", f"{n} Shipping Ltd", f"{n} & Co.", f"{n} Bank AG", f"{n} GmbH", f"Société {n}", f"{n} Insurance Company", f"{n} und Söhne KG", f"{n.upper()} HOLDING SA", f"{n} Partners LLP", f"{n} Trust", f"Banque {n}", f"{n} Cooperative", f"{n} {self.made()} SA", f"{n} & {self.made()} Ltd", f"{n} & Daughters Ltd", f"{n} {self.pick(THINGS_NAMED)} {self.pick(['plc', 'SA', 'GmbH', 'Ltd', 'AG', 'KG', 'Inc.', 'NV'])}", f"{n} et Fils SARL", f"{n} Maritime plc", f"{n} Harbour Bonds SA", f"{n} & Sons Ltd", f"{n} Anleihe GmbH", f"{n} Freight Cooperative", f"{n} Trust Company", f"{n} und Partner KG", f"{n.upper()} HOLDINGS LTD", f"{n} Versicherung AG"])

    def o(self) -> str:
        thing = lambda: self.pick(THINGS_NAMED)
        made = self.made()
        return self.pick([f"{made} {thing()}", f"{thing()} {thing()}", f"{made} {thing()} {thing()}", f"{thing()} of {made}", f"{made} & {self.made()} {thing()}", f"{thing()} {thing()} {thing()}", f"{thing()} {made}", thing(), f"{made} {thing()}".upper(), f"{made}-{thing()}"])

    def d(self) -> str:
        return self.pick([f"{self.pick('KC HB LT RC OG KG CJ TA'.split())} {self.rng.randrange(1, 9000)}/{self.rng.randrange(10, 60)}", f"{self.letter()[0]}{self.letter()[0]} {self.rng.randrange(1, 9000)}/{self.rng.randrange(10, 60)}", f"{self.rng.randrange(1, 40)} {self.letter()[0]} {self.rng.randrange(1, 900)}/{self.rng.randrange(10, 60)}", f"[{self.rng.randrange(1980, 2024)}] {self.letter()[0]}{self.letter()[0]} {self.rng.randrange(1, 400)}"])

    def w(self) -> str:
        return self.pick([*TOWNS, self.made()])

    def g(self) -> str:
        return self.pick(COURTS)

    def h(self) -> str:
        k, page = self.d(), self.rng.randrange(2, 60)
        return self.pick([f"{k} – Page {page}", f"{self.surname()} v {self.pick([self.s(), self.c()])} | {k} | Page {page} / 9", f"{k}, page {page}", f"- {page} -", f"Seite {page}", f"{self.surname()} v {self.pick([self.s(), self.c()])} | {page} | {k}", f"{self.pick(COURTS).upper()}    {page}"])

    def _clause(self, openers: list[str], words: list[str], nouns: list[str] = ()) -> str:
        out = [self.pick(openers)]
        for _ in range(self.rng.randrange(4, 16)):
            if self.rng.random() < 0.35:  # words the field has never seen
                made = self.made().lower() + self.pick(["", "", "ed", "s", "ung", "ance", "keit", "age", "ment", "ing"])
                out.append(made.capitalize() if nouns and self.rng.random() < 0.5 else made)
            else:
                out.append(self.pick(nouns) if nouns and self.rng.random() < 0.4 else self.pick(words))
            if self.rng.random() < 0.1:
                out[-1] += ","
        return " ".join(out) + self.pick([".", ".", ";"])

    def b(self) -> str:
        return self._clause(OPENERS, PLAIN)

    def u(self) -> str:
        return self.b().upper()

    def k(self) -> str:
        return self._clause(GERMAN_OPENERS, GERMAN_SMALL, GERMAN)

    def f(self) -> str:
        return self._clause(FRENCH_OPENERS, FRENCH)


def labelled(given: list[str], copies: int = 8, seed: int = 3, together: int = 5) -> list[list[tuple[str, str | None]]]:
    """Passages as pieces of (text, label or None): each row filled ``copies`` times, ``together`` rows in random order a passage."""
    fill, out = Filler(given, seed), []
    for row, general in [(r, rows is GENERAL) for rows in (GENERAL, RULINGS) for r in rows.split("\n") if r]:
        parts = re.split(r"\{(\w)\}", row.replace("\\n", "\n"))
        fill.rulings = not general
        for _ in range(copies):
            wrap = fill.rng.random() < 0.15
            fixed = [re.sub(r"\d", lambda m: fill.digits(1), p) for p in parts]  # numbers in the wording vary
            if general and fill.rng.random() < 0.6:  # as in wording that the table does not have
                fixed = [re.sub(r"\b[^\W\d_A-ZÀ-Þ]{3,}", lambda m: fill.unknown() if fill.rng.random() < 0.6 else m.group(), p) for p in fixed]
            out.append([(getattr(fill, p)(), LABELS.get(p)) if i % 2 else (fixed[i], None) for i, p in enumerate(parts)])
            if wrap:  # hard line breaks of scanned text
                out[-1] = [("".join("\n" if c == " " and fill.rng.random() < 0.15 else c for c in x), label) for x, label in out[-1]]
    fill.rng.shuffle(out)

    def gap() -> str:
        """What lies between sentences: a blank, a break, a paragraph's number or a page header."""
        n, kind = fill.rng.randrange(1, 40), fill.rng.random()
        if kind < 0.45:
            return " "
        if kind < 0.55:
            return fill.pick(["\n\n", "\n"])
        number = fill.pick([f"({n}) ", f"§ {n} ", f"{n}. ", f"{n} ", f"[{n}] ", f"Rn. {n} "])
        return fill.pick(["\n\n", "\n\n", "\n"]) + (number if kind < 0.85 else f"{fill.h()}\n\n{number}")

    return [[x for row in out[i : i + together] for x in (*row, (gap(), None))] for i in range(0, len(out), together)]
