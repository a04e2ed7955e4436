"""Preparation of alarm texts and current profiles for training language models.

Nothing outside this folder imports it. Records are the project's alarms
(``alarm_event_id``, ``alarm_name``, ``station_name``) and device current
profiles; every operator reads the columns it names and leaves others alone.
"""
