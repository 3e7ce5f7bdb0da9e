"""Tables as data, and the jobs that run over them."""
