"""The small labelled table the personal-data model is trained from.

`{kind:text}` marks a span; everything else is labelled as nothing.  All names, numbers and addresses are invented.
"""

# Fixed training rows.
MARKED = """
please call me at {phone:(415) 555-2671} tomorrow
phone {phone:415-555-0132} or write to us
Tel. {phone:(020) 7946 0018} ext 4
my mobile is {phone:07700 900 123} thanks
fax {phone:555-867-5309}.
Call {phone:1-800-555-0199} now
cell: {phone:650.555.0147}, ask for Ana
telefon {phone:030 123 456 78} ab neun
téléphone {phone:01 99 00 12 34} le soir
llame al {phone:91 555 01 23} por favor
the the and {phone:(487) 555-7209} or ther in
contact {phone:(614) 555-8001} eron the
reach her on {phone:212 555 0187} after six
ring {phone:+44 20 7946 0958} today
number {phone:+1 (443) 555-5793} is new
write to {email:jane.doe@example.com} soon
mail {email:sales@shop.example.org} for offers
e-mail: {email:a_b-c@mail7.example.com}.
and.{email:34@mail7.example.com} the of
contact {email:jane [at] example [dot] com} please
reach me at {email:bob (at) mail (dot) example (dot) org} or not
address is {email:max.muster [at] example.de} danke
write {email:info(at)example(dot)net} today
email {email:ana [AT] correo [DOT] example} hoy
to {email:user42 [at] host7 [dot] example [dot] com} she wrote
mail us: {email:press(at)news.example.org}
mail {email:c.d@site.example.com} or {email:jane [at] place [dot] com}, call later
ask {email:tom [at] work [dot] net} or {email:lea [at] home [dot] org}.
the of {email:kim [at] lab [dot] edu}, and the
send it to {email:eve (at) club (dot) com}, please
or {email:joe [at] shop [dot] com} or else
card {card:4111 1111 1111 1111} expires soon
paid with {card:5500-0000-0000-0004} yesterday
number {card:4012888888881881} on file
visa {card:4111.1111.1111.1111} was charged
credit card {card:3782 822463 10005} ok
my card is {card:6011 0009 9013 9424}.
account card {card:4000.0566.5566.5556} valid
host {ip:192.168.10.4} is down
from {ip:10.0.0.7} to here
server at {ip:203.0.113.77} answers
IP {ip:198[.]51[.]100[.]23} was blocked
seen at {ip:203[.]0[.]113[.]9} again
address {ip:192(.)0(.)2(.)44} in the log
version 3.0 of the licence
Licensed under CC BY-NC 4.0.
Apache License, Version 2.0
order 12345 shipped on 2024-05-01
pages 12-15 of book 3
it cost 1,299.00 in 1998
at 10:30 we left
room 204 (2 beds) and 3 chairs
in 2019 (see 4.2) they won 3-1
score 21-19, 21-17 in two sets
figure 12.4.1 shows 56 cases
chapter 7 [at] the end
he looked [dot] dot and left
ISBN 978-3-16-148410-0 is a book
born 12.03.1975 in the town
between 100 and 200 people
the year 1999-2000 was cold
section 3.2.1.1 of the code
ticket 20240501123456 closed
model XJ-900 with 16 GB
population 1 234 567 in 2010
1 2 3 4 5 6 7 8 9 10
add 250 g flour and 3 eggs
@ the corner of 5th street
follow @someone for 10 days
from 9 to 5 on weekdays
token = "cf1d64a9a4cd9723e1f4" the
route 66 and exit 24
line 10 column 5: error 404
ratio 3:2 and 16:9 screens
tag v1.2.3-rc4 released
the 2nd and 3rd of 12
"""
