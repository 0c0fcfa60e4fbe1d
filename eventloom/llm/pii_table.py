"""The labelled table from which the recogniser of personal information is trained."""

# Sentences of reviews, one a line, with labelled spans [kind|text]. The kinds code,
# item, brand and word are no personal information. All content is invented.
SENTENCES = """\
My number is [phone|+44 20 7946 0114], please send a new one.
My number is [phone|(740) 555-0113], please send a new one.
my number is [phone|16665550152], please send a new one
Call me on [phone|(803) 555-0150] after six.
Call me on [phone|020 7946 0720] after six. again: [phone|020 7946 0720]
Call me on [phone|607-555-0179] after six.
They still haven't rung [phone|943.555.0180] back.
They still haven't rung [phone|+447700900592] back.
ph:[phone|020 7946 0848]
ph: [phone|734.555.0156]
ph:[phone|+1 462 555 0184]
Tel. [phone|+1 413 555 0150]
Tel. [phone|020 7946 0805]
Text [phone|+1 470 555 0129] before you come.
Text [phone|12035550126] before you come.
whatsapp [phone|+1 837 555 0173]
whatsapp [phone|16365550138]
whatsapp [phone|18995550130] ([phone|18995550130])
Text [phone|13175550145] before you come.
ph:[phone|19705550100]
My number is [phone|17905550153], please send a new one.
whatsapp [phone|686‑555‑0107]
The courier has [phone|(0117) 496 0111] and never used it.
The courier has [phone|985-555-0175] and never used it.
[phone|07700 900493], as I said.
([phone|18995550130])
[phone|+447700900337]!
again: [phone|07700 900693]
Tel. [phone|12475550179]
Tel. [phone|+447700900388]
ph:[phone|16125550144]
ph:[phone|+447700900009]
whatsapp [phone|+447700900877]
whatsapp [phone|13795550167]
Call me on [phone|16065550189] after six.
They still haven't rung [phone|18225550192] back.
The courier has [phone|16525550168] and never used it.
Rappelez-moi au [phone|06.39.98.25.53].
Rappelez-moi au [phone|01 99 00 05 42].
Rappelez-moi au [phone|+33 6 39 98 98 04].
Tél : [phone|+33 6 39 98 75 17]
Tél : [phone|0199000769]
Tél : [phone|0199008033]
Tél : [phone|0199002247] Ma fille l'adore.
Bitte unter [phone|040 66969 771] zurückrufen.
Bitte unter [phone|(030) 23125-928] zurückrufen.
Bitte unter [phone|0221/4710053] zurückrufen.
Tel.: [phone|+49 30 23125496]
Tel.: [phone|0176 04069088]
Llámenme al [phone|+34 555 01 01 26].
Llámenme al [phone|555 010 891].
Tel. [phone|+34 555 01 02 17]
Llámenme al [phone|555-010-956].
Phone [phone|020 7946 0301] or write.
Reach me at [phone|+1 212 555 0147] any evening.
My mobile is [phone|07700 900111].
My social security no. [id_number|QQ922028A] was printed on the slip!
My social security no. [id_number|926252394] was printed on the slip!
My social security no. [id_number|985-22-3891] was printed on the slip
Patient id number: [id_number|QQ903295D].
Patient id number: [id_number|947-41-8327].
The pharmacist typed [id_number|QQ315351A] as my insurance number.
The pharmacist typed [id_number|925-39-0580] as my insurance number.
They even asked for my national insurance number, [id_number|960 11 1234].
They even asked for my national insurance number, [id_number|QQ 94 25 29 A].
ID [id_number|934-13-9132] was on the delivery form.
ID [id_number|954165915] was on the delivery form.
ID [id_number|QQ 93 01 84 B] was on the delivery form.
SSN [id_number|QQ 13 70 97 C], yes, on the outside of the box.
SSN [id_number|913195536], yes, on the outside of the box.
(insured person [id_number|986495319])
(insured person [id_number|QQ 63 96 23 B])
My social security no. [id_number|921–45–3161] was printed on the slip!
([id_number|985-22-3891])
Why does the warranty form need [id_number|910112382], my tax number?
Why does the warranty form need [id_number|QQ 84 10 63 B], my tax number?
[id_number|961187304], as I said.
again: [id_number|962 41 4386]
[id_number|QQ548109B]!
Sogar meine Ausweisnummer [id_number|M000935024] stand auf dem Paket.
Sogar meine Ausweisnummer [id_number|L0F433797] stand auf dem Paket.
Sogar meine Ausweisnummer [id_number|T12562186] stand auf dem Paket.
Versichertennummer [id_number|T96786781] wurde verlangt.
Versichertennummer [id_number|X000745404] wurde verlangt.
Versichertennummer [id_number|L0H265765] wurde verlangt.
Pièce d'identité n° [id_number|9 48 13 99 682 397 33] notée sur le bon.
Pièce d'identité n° [id_number|906139958945610] notée sur le bon.
On m'a demandé mon numéro de sécu, [id_number|944139993520149] !
On m'a demandé mon numéro de sécu, [id_number|9 25 13 99 852 535 12] !
On m'a demandé mon numéro de sécu, [id_number|937139920386210] !
Mon numéro de sécu est [id_number|941139949829756].
El documento [id_number|00003180G] salía en la etiqueta.
El documento [id_number|X0009839A] salía en la etiqueta.
El documento [id_number|00.009.096-W] salía en la etiqueta.
Pidieron mi DNI, [id_number|X0000689M].
Pidieron mi DNI, [id_number|00.003.289-G].
Pidieron mi DNI, [id_number|00004853R].
My passport no. [id_number|K000330933] is on the parcel.
My clinic number [id_number|947 38 4293] was shown.
You can write to me at [email|noor81@inbox.test] if you want details.
You can write to me at [email|HEDDA.QUINIERE+SHOP@INBOX.TEST] if you want details.
I left my address ([email|emre-quinley98@inbox.test]) and nobody replied.
I left my address ([email|ulla-ilvard68＠example . com]) and nobody replied.
The invoice went to [email|mneststrom@post.example.net] by mistake.
Send the refund form to [email|quinard_leocadia@inbox.test], not to my old inbox.
Send the refund form to [email|vdralstrom [at] example [dot] com], not to my old inbox.
[email|mheskez @ post.example.net] is what I registered with.
[email|ruben.quinmann+shop@example.org] is what I registered with.
Questions? [email|inigo.karrowski (at) example.org]
Questions? [email|cmondley＠inbox.test]
contact: [email|oona.brelard+shop@post.example.net]
contact: [email|celia.tholard+shop [at] mail [dot] example]
mail:[email|halvard75@example.org]
mail:[email|imani-gansova98 @ home.invalid]
<[email|oona.feltowski@inbox.test]>
([email|nadja.pralstrom+shop@inbox.test])
[email|farid.feltard@mail.example]!
[email|mheskley@uni.example.edu], as I said.
again: [email|dario-sorbstrom99@uni.example.edu]
Écrivez-moi à [email|anouk.heskley@post.example.net].
Mon adresse est [email|rstavlin@home.invalid].
Mi correo es [email|jorun8@inbox.test].
Escríbanme a [email|mark49 [at] mail [dot] example], por favor.
Escríbanme a [email|kenji62@uni.example.edu], por favor.
Meine Adresse [email|jorun.gansowski+shop@home.invalid] wurde ignoriert.
Fragen gern an [email|isandro.feltowski@example.org].
Signed, [name|Teodor Tholmann]
Signed, [name|Mirek-Nadja Olbard]
Thanks to [name|Katinka Olbley] for the quick help.
Thanks to [name|Nadja D. Pralley] for the quick help.
It was a present for [name|Kenji Dralova], who is eighty.
It was a present for [name|DAGNY STAVMANN], who is eighty.
Nurse [name|Ruben Ruskière] showed us the settings.
Nurse [name|Rose E. Heskley] showed us the settings.
[name|Saskia Stavowski] here again with an update.
[name|N. Nestlin] here again with an update.
[name|SKY THOLMANN] here again with an update.
[name|Orla Gansick] from the shop was very patient.
[name|Farid Stavard-Vensström] from the shop was very patient.
The account is under [name|Hedda Gansick].
The account is under [name|Farid-Leocadia Feltlin].
The account is under [name|Ulmowski, Nadja].
My neighbour [name|iñigo karrlin] has two of them.
My neighbour [name|Brelström, Saskia] has two of them.
I spoke to [name|Wilhelmina Ganslin] on the phone.
I spoke to [name|Tarnez, Oona] on the phone.
I spoke to [name|Elspeth B. Olbière] on the phone.
Ask for [name|Ruben Sorbström] at the counter.
Ask for [name|Lucía Tholmann] at the counter.
My doctor, Dr. [name|T. Sorbick], uses the same one.
My doctor, Dr. [name|Feltley, Björn], uses the same one.
My doctor, Dr. [name|chidi ilvmann], uses the same one.
[name|Oona Pralick], as I said.
([name|Oona Ilvard])
[name|Fenna B. Quinez]!
again: [name|Hunter-Wilhelmina Mondez]
- [name|Dario Tarnick]
- [name|Pascale H. Ilvlin]
[name|Rafe Olbley] vom Service war sehr nett.
[name|G. Pralowski] vom Service war sehr nett.
Gruß, [name|Xenia Tarnard]
Gruß, [name|Nestmann, Priya]
Laut Frau [name|Pascale Vensez] dauert es noch.
Laut Frau [name|Olbez, Dario] dauert es noch.
Laut Herrn [name|Emre Heskova] dauert es noch.
Merci à [name|Fenna Quinley] pour son aide.
Merci à [name|Nadja D. Ulmick] pour son aide.
Signé [name|Petra Ruskley]
Signé [name|S. Mondière]
[name|Chidi-Björn Karrova] au téléphone a été charmant.
[name|Rose Stavick] au téléphone a été charmant.
Gracias a [name|Anouk Tholowski] por la ayuda.
Gracias a [name|Tomas L. Ruskowski] por la ayuda.
Firmado: [name|Xenia Wexlmann]
Firmado: [name|MARK QUINIÈRE]
[name|Emre Pralström] me atendió muy bien.
[name|V. Stavova] me atendió muy bien.
Talk to Ms [name|Grace Feltard] or Mr [name|Will Heskard].
It was left outside [address|217 E. Juniper Close] in the rain.
It was left outside [address|147 Harrowmere Street, Apt 9B] in the rain.
I live at [address|80 N. Twelfth Blvd], second bell.
I live at [address|PO Box 4822], second bell.
I live at [address|109b bramley blvd], second bell.
Pick it up any day, [address|237 S. Kestrel Way].
Pick it up any day, [address|37 Bramley Way, Flat 35C].
Deliver to: [address|52 N. Kestrel Way]
Deliver to: [address|42 Juniper Close, # 18]
Deliver to: [address|48c kestrel lane]
Deliver to: [address|131 Saint Orrin Lane, Unit 30C]
Deliver to: [address|PO Box 3356]
We moved from [address|240 W. Harrowmere Ave] last spring.
We moved from [address|130 Foxglove Road, Flat 10C] last spring.
Please send the spare to [address|17 Kestrel Close].
Please send the spare to [address|PO Box 5215].
Please send the spare to [address|184c twelfth street].
[address|206 Saint Orrin Road] is easy to find, yet they got lost.
[address|PO Box 6189] is easy to find, yet they got lost.
The van stopped at [address|42 Kestrel Blvd] instead of ours.
The van stopped at [address|185 Harrowmere Blvd, # 9C] instead of ours.
([address|151 W. Willowmere Way])
[address|45 Bramley Street], as I said.
again: [address|222 bd de la Fontaine]
[address|50 N. Saint Orrin Street]!
Ich wohne [address|Am Hang 45], Hinterhaus.
Ich wohne [address|Ahornstraße 157b], Hinterhaus.
Ich wohne [address|Ahornweg 49], dritter Stock.
Bitte liefern an [address|Lindenstr. 83].
Bitte liefern an [address|Am Weiher 234].
Bitte liefern an [address|Haselgasse 45].
Bitte liefern an [address|Postfach 1234].
Merci de livrer au [address|175 avenue des Aubépines].
Merci de livrer au [address|204 bis, chemin du Moulin].
Merci de livrer au [address|172 bis bd de la Fontaine].
Le colis était devant le [address|178, bd de la Fontaine].
Le colis était devant le [address|107, rue du Moulin].
Vivo en [address|Plaza del Olmo, 24], segundo piso.
Vivo en [address|Calle Alameda nº 32], segundo piso.
Vivo en [address|C/ de los Pinos, 197], segundo piso.
Vivo en [address|Avenida de los Pinos, 113], segundo piso.
Envíenlo a [address|Calle de la Noria nº 103].
Envíenlo a [address|Plaza del Olmo nº 41].
Serial [code|SN84294301] is on the back.
Serial [code|920-40-5721] is on the back.
The sticker says model [code|QX 35 55 25 H].
The sticker says model [code|983-26-2542].
Order no. [code|3364-538-9690] came in 8 parcels.
order no. [code|A2071949] came in 51 parcels
Part [code|4765468388] is the spare mask.
part [code|750 6674 33] is the spare alarm
Booklet [code|842 6303 51] covers page 8 to 411.
Code [code|3528-709-7988] opens the app.
Batch [code|985-13-8832], lot [code|490 9463 14].
batch [code|QX 53 29 27 F], lot [code|A4963502]
Seriennummer [code|42/555-8457] steht hinten.
Seriennummer [code|963-20-1168] steht hinten.
Bestellung [code|938 3135 25], bezahlt 1 967,00 kr.
Bestellung [code|9267365526], bezahlt £76.
Commande [code|1060-562-6181], payée £11.
Numéro de série [code|926-15-4829] au dos.
Numéro de série [code|QX 99 11 13 G] au dos.
numéro de série [code|SN44907831] au dos et version 9.1.4.2 installée
Número de serie [code|QX 53 13 81 F] detrás.
Seriennummer [code|QX 23 10 37 E] steht hinten.
the sticker says model [code|QX 22 84 81 G] - my husband's hearing aid wakes nobody
Pedido [code|A1185351], pagué 80,10 €.
Número de serie [code|14/555-9998] detrás.
Брал для дома, заказ [code|825 6138 51].
注文番号は[code|5218-170-8137]です。
ऑर्डर [code|8497-343-1132]।
رقم الطلب [code|244 6533 93].
[code|1234567890123]
10.0.163.1
v9.13.0.9
Firmware 8.20.9.18 was installed.
since the update to 7.15.1.30
Die Firmware 7.20.3.7 ist drauf.
Version 3.7.9.22 installée.
Tiene la versión 6.0.8.16.
バージョン6.15.6.20が入っていました。
Прошивка 4.3.5.19.
It was set up by the store at 20:07 on 2022-12-27.
Paid $116.23 for it in June.
Paid 1 632,00 kr for it in October.
which is odd for 125,67 €
It measures 289 x 7 mm.
Maße: 329 x 252 mm.
Mide 70 x 277 mm.
We've tried 190 others; this one's the best, and you need 297 AAA batteries.
It took 80 Road Trips to the Bramley store.
After 66 tries it still wouldn't pair.
Readings were off by 308 points.
Battery lasts about 142 days, which is fairly accurate.
Set-up took 387 minutes and the charger was ready.
The display says 167.4 most mornings.
Will it last? Grace period was 347 days.
The Rose Quartz colour is nice.
The Mark II pump is better.
In May the sensor stopped blinking.
Hope it lasts, no sky colour in summer.
Sold by Willowmere Lane Trading, unit [word|Ixke].
Meet me @ the counter of [brand|Umbralune].
meet me @ the counter of [brand|Hallow & Reed]
[brand|Marlow Finch] calls it the [word|Ixlorglygly] mode.
I expected more from [brand|Quillon].
[brand|Otterbeck] hat mich überzeugt.
Nie wieder [brand|Brightwell Park].
[brand|Norvessel] m'a convaincu.
[brand|Zentolar] me convenció.
Спасибо [brand|Umbralune] за хорошую вещь!
Thanks to [brand|Pellucid] for nothing.
[brand|Quillon] did it again.
I would buy the [item|Nimix Mini 339] again without thinking.
Don't waste your money on the [item|Talara X666].
[item|Orulo Pro 828] : décevant.
[item|NIMIX MINI 339]: laut.
The new [item|Sereon Mini 8] froze during the update, or so my uncle says.
There is a [word|Rute] cap and a [word|ziglyte] ring.
The [word|Lorglysten] [word|Fentete] edition has a better charger.
The spare cable has a [word|Quavomifen] label and uses the [word|Tevodra] plug.
Auf dem Display steht [word|rumi].
Il est écrit [word|Fenke] sur le chargeur.
En el sensor pone [word|Keondra].
The screen comes in dark blue.
A leaflet in the hall drawer explains the cuff.
The box holds the pump, a app and a leaflet.
I have used this chest strap for a month and it is still light.
I bought it for my mother.
My neighbour loves it. My flatmate sent it back.
My wife's smart scale pinches the skin.
Five stars from my uncle.
It's leaky, it's annoying, and the lid won't stay on.
Our second hearing aid is made for left hands.
Steht jetzt in der Diele. Würde ich sofort wieder kaufen.
Nutze das Gerät seit einem halben Jahr, es ist leise.
Gekauft für meine Tochter. Nachts stört es niemanden.
Das Netzteil ging nach einem Monat kaputt.
Mal sehen, ob das Display hält.
Acheté pour ma voisine. Je l'ai renvoyé.
Dans la boîte : le chargeur et le câble.
Je l'utilise depuis un mois, c'est pratique.
Ma fille l'adore. Reçu à l'heure.
A mi madre le encanta y veremos si el cargador aguanta.
La caja trae el botón y un cable.
Llegó tarde. Lo compré para mi vecina.
@deal_hunter_171
#3 x² ½ :-) — ok
http://shop.example/p?id=189
www.shop.example/item/42
<br> I'LL don't've <unk> [PAD] <|endoftext|>
Is the cuff sturdy? 5 stars! Wow!!!
1. 2. 3. * - o
色は白です。重さは202グラムです。
Экран яркий, ремешок мягкий. Пришло во вторник.
शोर बहुत है। रंग सफ़ेद है।
الشاشة واضحة. أمي سعيدة به جدا.
It was a present for my mother, who is eighty.
Thanks to the shop for the quick help.
I spoke to the shop on the phone.
The van stopped at the corner instead of ours.
Call me old, but it works. Deliver to the door.
My account is locked since the update to 3.7.5.8.
The invoice went to the wrong floor by mistake.
It was set up by the store at 06:06 on 2024-04-13, and not sure yet whether the screen will last.
It was set up by the shop on 2021-03-05.
Après deux semaines, rien à redire.
Après trois jours, rien à redire, mais commande [code|428 8443 65], payée £19.
Après un mois, rien à redire. Acheté pour ma fille. Très silencieux pour ce prix.
Après 138 essais, j'ai abandonné. C'est plutôt fragile.
Il faut 292 piles. Il se déconnecte toutes les 102 minutes.
Le câble pèse 204 grammes. Les mesures sont fausses de 360 points.
Installation en 348 minutes. On verra si le bracelet tient.
Le boîtier est bruyant, le capteur aussi. Très pratique pour ce prix.
Je le rachèterais sans hésiter. N'achetez pas chez [brand|Avenra] !
Comparé à l'ancien de [brand|Tessaly], le capteur est plus grand.
Ça ne réveille personne la nuit. La notice n'aide pas.
El cable se rompió a los 29 días, aunque llegó a tiempo.
Se desconecta cada 182 minutos. Tras 333 intentos me rendí.
Lleva 396 pilas. El botón pesa 300 gramos. Las medidas fallan por 270 puntos.
Se instala en 341 minutos. Tras dos semanas, sigue igual.
Lo uso desde hace dos semanas y es cómodo. No despierta a nadie de noche.
Por ese precio, muy preciso. ¡Lo compraría otra vez! Lo devolví enseguida.
Настроил за 213 минут, но нужно 18 батарейки. Вернул обратно.
Вес 403 граммов. Работает отлично уже 27 месяцев, и прошивка 2.18.9.0.
Сломался через 411 дней. Связь пропадает каждые 135 минут.
Цена $166.71. Цена 1 562,00 kr, но пришло во вторник.
[item|Nimix Mini 339] лучше старого. Маме очень понравилось.
電池は143本必要です。注文番号は[code|A2094620]です。
362分で設定できました。44回試しましたがつながりません。
369か月使って、まだ元気に動いています。153日で壊れました。
火曜日に届きました。説明書は小さい字です。数値が合いません。
[item|Talara HT-424]は本当に良いです！母も気に入っています。
367 मिनट में चालू हो गया। 145 बैटरी लगती हैं।
यह 405 महीने से अच्छा चल रहा है। वज़न 343 ग्राम है।
हर 5 मिनट में बंद हो जाता है। 239 दिन में खराब हो गया।
يحتاج إلى 110 بطاريات. الوزن 348 غرام. التركيب خلال 83 دقائق.
ينقطع الاتصال كل 371 دقائق. تعطل بعد 275 أيام.
يعمل بشكل ممتاز منذ 23 أشهر. رقم الطلب [code|1844207087].
Die Einrichtung dauerte 94 Minuten. Man braucht 88 Batterien.
Der Akku hält 87 Tage. Nach 109 Versuchen habe ich aufgegeben.
Die Verbindung bricht alle 291 Minuten ab. Die Werte weichen um 252 Punkte ab.
Das Display wiegt 5 Gramm. Es kam am Dienstag an. Leider sehr ungenau.
[item|Vesido Mini 981]: enttäuschend. Im Karton lagen Netzteil und Kabel.
Verglichen mit dem alten von [brand|Quillon] ist das Kabel größer.
Für den Preis überraschend günstig. Meine Nachbarin ist begeistert.
Das Armband ist enttäuschend und das Gehäuse auch. Ich habe es zurückgeschickt.
My uncle's pill box was packed in foam, just like the one from [brand|Tessaly].
My wife's thermometer went through customs and its strap still looks new.
My neighbour's blood pressure cuff saves me a trip to the clinic, if you follow step 8.
My dad's sleep tracker stays with my flatmate now.
The handle on mine needs no manual, since the update to 6.6.3.11.
The grey lid drifts by 8 points, as the leaflet said.
The clip on mine uses the [word|miquaquazi] plug, even when it rains.
The spare sensor shows an error 64 and the scale plate too leaks on the carpet.
Even the hinge has 5 holes, just like the one from [brand|Zentolar].
The spare pump sits on the shelf in the office and the mint one wakes nobody.
This pulse oximeter was set to 143.9.
Readings agree with the ones at the clinic, but it arrived on a Tuesday.
The box was open and the charger was missing, and part [code|A3789097] is the spare sensor.
Finally a thermometer that just works! Order no. [code|A4237984] came in 232 parcels.
If you look for a glucose meter, look no further than [brand|Tessaly].
I received the [item|Calara Mini 554] and must say: reliable quality, clear design.
The whole family is happy. Highly recommend to all.
They use it on weekdays and keep it in the hall.
Support never answered about the app. It gets hot, very cheap.
I compared it with the old smart scale I had. Comfortable handle, accurate price.
12 months on, still fine. 40 hours, 3 of 5 parts.
café &amp; more dÃ©jÃ vu $$$ 👍👍 🙂
If anything is unclear you can ring [phone|+44 20 7946 0114] until nine.
My landline, [phone|(740) 555-0113], was dead that week.
They should phone [phone|607-555-0179], not my office.
Please dial [phone|020 7946 0720] and ask for the front desk.
His cell phone is [phone|734.555.0156] in case you need it.
Best to try [phone|07700 900493] in the morning.
Leave a voicemail at [phone|+1 462 555 0184] and I will answer.
My old fax [phone|0117 496 0111] still works.
I gave the agent two numbers, [phone|985-555-0175] and [phone|07700 900111].
Contact details: [phone|+447700900592]
Mobile: [phone|07700 900111]
You'll get me under [phone|12035550126] most days.
Someone called from [phone|943.555.0180] and hung up.
Tel: [phone|16665550152]
Tel [phone|020 7946 0805]
SMS to [phone|19705550100] works too.
Her phone number was given as [phone|555-010-956].
Meine Handynummer lautet [phone|0176 04069088].
Sie können mich unter der Nummer [phone|+49 30 23125496] anrufen.
Rückruf erbeten: [phone|(030) 23125-928]
Telefonisch bin ich über [phone|040 66969 771] zu erreichen.
Festnetz [phone|0221/4710053], abends.
Mon portable : [phone|06.39.98.25.53]
Vous pouvez me joindre au [phone|01 99 00 05 42] le soir.
Appelez le [phone|+33 6 39 98 98 04] avant midi.
On m'a laissé un message sur le [phone|0199000769].
Mi teléfono es el [phone|555 010 891].
Pueden llamarme al móvil [phone|+34 555 01 01 26] por la tarde.
Marquen el [phone|555-010-956] y pregunten por mí.
His passport number is [id_number|K000330933].
The receptionist wrote down my health card number [id_number|947-41-8327].
Tax id [id_number|910112382] had to be entered twice.
Driver's licence [id_number|K000330934] was copied without asking.
Member number at my insurer: [id_number|QQ315351A].
My NI number is [id_number|QQ 94 25 29 A].
NHS number [id_number|960 11 1234] appears on the label.
The form already showed my medical record number, [id_number|925-39-0580].
Medicare id [id_number|934139132]
They read out my social security number, [id_number|926-25-2394], in front of everyone.
The hospital file [id_number|947 38 4293] is mine.
Identity card [id_number|L0F433797] was scanned at the door.
Meine Sozialversicherungsnummer [id_number|T12562186] musste ich nennen.
Die Krankenkasse kennt mich als [id_number|X000745404].
Reisepass [id_number|L0H265765] lag dabei.
Personalausweis Nr. [id_number|M000935024] wurde kopiert.
Mon passeport porte le numéro [id_number|906139958945610].
Carte vitale [id_number|9 48 13 99 682 397 33] demandée au guichet.
Numéro d'assuré : [id_number|944139993520149]
Mi pasaporte es el [id_number|X0009839A].
Número de la seguridad social [id_number|00.003.289-G] en el sobre.
NIE [id_number|X0000689M] y firma.
My e-mail is [email|noor81@inbox.test] for replies.
Reply to [email|ulla-ilvard68＠example . com] please.
You can reach us through [email|oona.brelard+shop@post.example.net].
The confirmation was sent to [email|quinard_leocadia@inbox.test] twice.
Email: [email|vdralstrom [at] example [dot] com]
I signed up with [email|mheskez @ post.example.net] back then.
Schreiben Sie bitte an [email|jorun.gansowski+shop@home.invalid].
Kontakt per Mail: [email|halvard75@example.org]
Répondez à [email|anouk.heskley@post.example.net] merci.
Mon courriel : [email|rstavlin@home.invalid]
Contáctenme en [email|kenji62@uni.example.edu] cuando puedan.
My correspondent [name|Teodor Tholmann] wrote the first part.
A technician named [name|Ruben Ruskière] came by.
The engineer, [name|Kenji Dralova], replaced the seal.
Our physiotherapist [name|Orla Gansick] recommended it.
Written by [name|Nadja D. Pralley].
Customer: [name|Saskia Stavowski]
Regards, [name|Hedda Gansick]
Best wishes [name|Oona Pralick]
Yours sincerely, [name|T. Sorbick]
Mr. [name|Emre Pralström] never answered.
Mrs [name|Dagny Stavmann] lives upstairs and has the same one.
Miss [name|Lucía Tholmann] at reception knew the answer.
Professor [name|Elspeth B. Olbière] mentioned it in class.
According to [name|Wilhelmina Ganslin], it is normal.
My colleague [name|Chidi Ilvmann] borrowed it for a week.
My sister-in-law, [name|Fenna B. Quinez], laughed about it.
I bought it together with [name|Rafe Olbley] last year.
[name|Priya Nestmann] answered my call and solved it.
The delivery was signed for by [name|N. Nestlin].
Registered to [name|Karrova, Chidi].
Patient: [name|Ulmowski, Nadja]
[name|Mirek Olbard] told me to write this.
When [name|Hunter Mondez] visited, it stopped.
We asked [name|Pascale H. Ilvlin] for advice.
Herr [name|Dario Tarnick] hat den Vertrag unterschrieben.
Unsere Pflegerin [name|Xenia Tarnard] zeigte es mir.
Mit freundlichen Grüßen [name|Priya Nest]
Dank [name|Emre Heskova] läuft es wieder.
Die Rechnung ging auf den Namen [name|Petra Ruskley].
Monsieur [name|S. Mondière] m'a rappelé.
Ma collègue [name|Anouk Tholowski] en possède un.
Cordialement, [name|Rose Stavick]
La señora [name|Tomas L. Ruskowski] me lo explicó.
Mi vecino [name|Mark Quinière] tiene otro.
Atentamente, [name|V. Stavova]
My home address is [address|217 E. Juniper Close].
Ship it to [address|147 Harrowmere Street, Apt 9B] this time.
The parcel went to [address|80 N. Twelfth Blvd] by mistake.
We have lived at [address|37 Bramley Way, Flat 35C] since May.
Our house, [address|109b bramley blvd], has no bell.
Just moved to [address|42 Juniper Close, # 18] and love it.
Billing address: [address|131 Saint Orrin Lane, Unit 30C]
Mail for me goes to [address|PO Box 4822].
The shop knows [address|50 N. Saint Orrin Street] as my place.
Next door to [address|17 Kestrel Close] there is a depot.
The driver waited near [address|206 Saint Orrin Road].
Residence: [address|48c kestrel lane]
Meine Anschrift: [address|Ahornstraße 157b]
Wir wohnen jetzt in der [address|Lindenstr. 83].
Das Paket lag vor dem Haus [address|Haselgasse 45].
Umgezogen in den [address|Ahornweg 49] im März.
Adresse : [address|204 bis, chemin du Moulin]
J'habite [address|107, rue du Moulin] depuis mai.
Nous avons déménagé au [address|175 avenue des Aubépines].
Mi dirección es [address|Calle Alameda nº 32].
Vivimos en la [address|Avenida de los Pinos, 113].
Lo dejaron en [address|Plaza del Olmo, 24] sin avisar.
Invoice number [code|A2071949] was missing.
Tracking number [code|4765468388] never updated.
The article [code|920-40-5721] is sold out.
Ticket [code|842 6303 51] is still open.
Reference [code|3528-709-7988] on the receipt.
Product code [code|QX 35 55 25 H] on the label.
Barcode [code|1234567890123] under the lid.
Device id [code|SN84294301] is shown in the menu.
Rechnung [code|938 3135 25] kam doppelt.
Artikel [code|963-20-1168] ist ausverkauft.
Facture [code|1060-562-6181] jointe.
Factura [code|9267365526] adjunta.
Chargennummer [code|490 9463 14] steht unten.
A nurse named [name|Ulla Ilvard] said the same, and so did [name|Otto Weber].
Another customer, [name|Carmen Torres], warned me.
Last week [name|George Hall] sold his.
Only [name|Claude Moreau] knows how to set it.
The name on it was [name|Heike Neumann].
My wife [name|Donna Clark] and my son [name|Kevin Clark] use it too.
Both [name|Pavel Nowak] and [name|Olga Petrova] agree.
Is [name|James T. Walker] from support real?
Regional manager [name|Brian Young] apologised.
Dr. [name|Birgit Richter] hat es verschrieben.
Der Fahrer, [name|Uwe Schulz], war freundlich.
Laut [name|Sabine Koch] ist das normal.
Avec [name|Julien Leroy], tout est allé vite.
Le docteur [name|Sylvie Durand] me l'a conseillé.
J'ai vu [name|Pierre Bernard] au magasin.
La doctora [name|Pilar Sánchez] lo recomienda.
Con [name|Javier Ramírez] todo fue fácil.
El técnico fue [name|Sergio Pérez].
The number is [phone|07700 900111] and nothing else.
Then I dialled [phone|020 7946 0805] again and again.
Office line [phone|(740) 555-0113], private [phone|+447700900592].
Use [phone|07700900111] if the door is locked.
Unter [phone|0176 04069088] meldet sich keiner.
Au [phone|06.39.98.25.53] ça ne répond pas.
Al [phone|555 010 891] no contesta nadie.
Why print my insurance number [id_number|934-13-9132] on the bag?
My clinic id is [id_number|947 38 4293] since May.
Passport [id_number|910112382] expired, they refused.
Le numéro de ma carte d'identité, [id_number|937139920386210], figure dessus.
Das Paket stand vor der [address|Haselgasse 45] im Regen.
Zwischen [address|Gartenweg 9] und dem Laden liegt der Park.
Someone on [address|44 Foxglove Road] has my parcel.
Devant le [address|12 place de la Gare] il pleuvait.
In Summer Road Trips it was great, 12 Street Lights helped.
Customer Service was friendly and Quality Control too.
Thank You so much, Dear Seller. Happy New Year!
The Battery Cover and the User Manual came separately.
Bluetooth Low Energy works on Android Phone and on the iPad.
I read Consumer Reports and the New York Times before.
Von der Deutschen Post kam nichts. Guten Tag und vielen Dank.
La Poste a perdu le colis. Bonne journée à tous.
Buenos días, el Servicio Técnico respondió pronto.
My Mother, my Father and Aunt used it in Room 12 on Floor 3.
Between 2019 and 2023 I had 3 of them, 100-200 uses each.
Measured 120/80 at 7:30, 118/79 at 21:45, pulse 64.
"""

# How numbers of each kind are written; d is any digit, A any capital letter. Forms
# that are one number and say little of themselves stand several times.
PHONES = """\
+44 20 7946 0ddd
020 7946 0ddd
07700 900ddd
+447700900ddd
+447700900ddd
(0117) 496 0ddd
+1 ddd 555 01dd
1ddd55501dd
1ddd55501dd
1ddd55501dd
1ddd55501dd
1ddd55501dd
1ddddddddd0
ddd-555-01dd
ddd.555.01dd
(ddd) 555-01dd
(ddd) 555 - 01dd
ddd‑555‑01dd
+34 555 01 dd dd
555 010 ddd
555-010-ddd
040 66969 ddd
(030) 23125-ddd
030 23125 ddd
+49 30 23125ddd
0176 040690dd
0221/47100dd
+33 6 39 98 dd dd
06.39.98.dd.dd
01 99 00 dd dd
019900dddd
019900dddd
019900dddd
0ddd dddddd
+dd ddd ddd dddd
ddd-ddd-dddd
"""
NUMBERS = """\
9dd-dd-dddd
9dd‑dd‑dddd
9dd–dd–dddd
9dd dd dddd
9dddddddd
QQddddddA
QQ dd dd dd A
M000dddddd
K000dddddd
L0Fdddddd
L0Hdddddd
Tdddddddd
X000dddddd
9 dd 13 99 ddd ddd dd
9dd1399ddddddddd
9dd1399ddddddddd
9dd1399ddddddddd
9dd1399ddddddddd
0000ddddA
X000ddddA
00.00d.ddd-A
ddddddddA
ddddddddd
Adddddddd
"""
CODES = """\
QX dd dd dd A
QX dd dd dd A
QX dd dd dd A
SNdddddddd
9dd-dd-dddd
9dd dd dddd
dd/555-dddd
dddd-ddd-dddd
ddd dddd dd
dddddddddd
Addddddd
ddddddddddddd
QQddddddA
ddd-555-dddd
ddddddddd
ddd dddd dd
"""
# Parts of addresses. A trailing + joins the next part.
STREETS = """\
Kestrel
Juniper
Harrowmere
Bramley
Old Mill
Saint Orrin
Twelfth
Calderfen
Foxglove
Willowmere
Station
High
Second
"""
ROADS = "Street St. Road Rd Lane Ave Avenue Blvd Way Close Crescent Drive Court"
GERMAN = "Ahorn+ Linden+ Brunnen+ Mühl+ Hasel+ Garten+ Schul+ Berg+ Kirch+ Wald+ Birken+ Dorf+ Bach+ Sonnen+"
GERMAN_ROADS = "straße str. weg gasse allee platz"
GERMAN_WHOLE = ["Am Hang", "Am Weiher", "Am Steinbruch", "Im Tal"]
FRENCH = ["des Aubépines", "du Moulin", "de la Fontaine", "des Tilleuls", "de la Gare"]
FRENCH_ROADS = "rue avenue bd chemin boulevard place"
SPANISH = ["del Olmo", "Alameda", "de la Noria", "de los Pinos", "Mayor"]
SPANISH_ROADS = "Calle Plaza C/ Avenida Paseo"
DOMAINS = "inbox.test example.org example.com post.example.net mail.example home.invalid uni.example.edu"
# Names that a table of names may lack (everyday names of several languages, and
# parts that family names are made of), and syllables for others.
OTHER_GIVEN = (
    "Signe Vasil Osric Ilka Célia Lucía Greta Isandro Ysolde Mark Rose Dagny Yusuf Tarek Lena Pavel Mina Otto James Robert Patricia Jennifer Michael Linda David Susan Karen Daniel Nancy "
    "Matthew Sandra Ashley Steven Kimberly Andrew Donna Joshua Michelle Kevin Carol Brian Amanda Dorothy George Deborah Hans Klaus Jürgen Wolfgang Ursula Monika Sabine Birgit Heike Stefan "
    "Uwe Jean Pierre Michel Claude Nathalie Isabelle Sylvie Catherine Françoise Julien Antoine José Manuel Francisco María Carmen Josefa Dolores Pilar Javier Sergio Giulia Marco Paolo Sofia "
    "Aisha Omar Fatima Wei Ming Yuki Hiroshi Priyanka Rahul Olga Dmitri Agnieszka Piotr"
)
OTHER_FAMILY = (
    "Mondez Quinard Brelström Stavmann Ulmova Nestmann Heskström Marden Koslin Vartan Oberlo Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Harris Clark "
    "Lewis Walker Hall Young Allen Wright Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Neumann Martin Bernard Dubois Durand Leroy Moreau "
    "Laurent Simon Lefebvre Garcia Rodríguez Martínez Hernández López González Pérez Sánchez Ramírez Torres Rossi Ferrari Nowak Kowalska Ivanov Petrova Chen Nguyen Patel Khan Okafor Mensah"
)
FAMILY_STARTS = "Ald Bar Bern Black Brook Car Clay Cross Dal East Fair Fern Gold Green Grim Hart Hay Hazel Hol Kirch Lang Lund Mar Mill Nord Oak Pem Rad Red Ros Schön Sil Stan Steg Thorn Vil Wald West Whit Win Wood"
FAMILY_ENDS = "berg bach born brook bury croft dale der ell feld field ford gate ham hurst land ley lin lock man mann more quist sen shaw son stein stone strom ton ville wald ward well wick wood worth eau ier ard ot ez era aga ova ski"
SYLLABLES = "ba ru mi vo gly dra sten fen ix ke lor qua te zi on mo sa bel tor"
